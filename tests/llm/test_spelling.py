"""Spelling variants against brute force."""

import random
import re
import zlib

import pytest

from seqloom.llm import spelling
from seqloom.llm.oracles import OP12
from seqloom.llm.queries import op12_spelling_variants
from tests import compare


def counts(docs):
    out = {}
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [x for x in words if edit(w, x)] for w in words}
    best = {w: min(((-words[x], x) for x in v), default=None) for w, v in near.items()}
    form = {w: b[1] if b and -b[0] >= 2 * words[w] else None for w, b in best.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(seed, n, letters="abé", low=5, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))): rng.choice((3, 4, 6, 9, 20, 50)) for _ in range(n)}


def test_against_duckdb(spark):
    assert compare.differences(spark, op12_spelling_variants, OP12, "/root/testdata/sf0.001") == []


@pytest.mark.parametrize("letters,low,high", [("abé", 5, 7), ("abcdefgh", 5, 6), ("ab", 46, 50), ("aÀÿ×", 5, 13)])
def test_against_brute_force(spark, letters, low, high):
    words = vocabulary(1, 250, letters, low, high)
    base = list(words)[:60]
    rng = random.Random(2)
    for w in base:  # near ones of long words
        at = rng.randrange(len(w))
        words[w[:at] + w[at + 1 :] if len(w) > 5 else w + "a"] = 3
        words[w[:at] + rng.choice(letters) + w[at:]] = 7
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(df)) == brute(words)


def test_hot_keys_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    words = {f"prefix{w}": n for w, n in vocabulary(3, 300, "abc", 1, 5).items()} | {f"{w}suffix": n for w, n in vocabulary(4, 100, "abc", 1, 5).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert spelling.visits(df).where("block > 3").count() > 0
    assert rows(spelling.variants(df)) == brute(words)


@pytest.mark.parametrize("direct,compared", [(1, 5), (20, 50), (4096, 1 << 17)])
def test_shards(monkeypatch, direct, compared):
    """Shards of several blocks, groups cut to the end, and a shard that goes on with more scanners."""
    monkeypatch.setattr(spelling, "DIRECT", direct)
    monkeypatch.setattr(spelling, "COMPARED", compared)
    words = list(vocabulary(5, 150, "ab", 6, 7)) + ["a" * 60, "a" * 59, "a" * 30 + "b" + "a" * 29]
    expected = {(a, b) for a in words for b in words if edit(a, b) and (len(a), a) < (len(b), b)}
    found = []
    for side in "^$":
        shard = spelling.Shard(side)
        for _ in range(2):  # the same words in two blocks: nothing is found across
            shard.open()
            for w in words:
                shard.add(w, 3, 0)
            for w in words[: len(words) // 2]:
                shard.add(w, 3, 1)
        onward = shard.onward()
        for w in words[len(words) // 2 :]:
            onward.add(w, 3, 1)
        first = [(shard.words[i], shard.words[j]) for i, j in shard.pairs()]
        assert sorted(first) == sorted([p for p in set(first) for _ in range(2)])
        found += [*set(first), *[(onward.words[i], onward.words[j]) for i, j in onward.pairs()]]
    assert sorted(found) == sorted(expected)


def test_odd_rows(spark):
    long = " ".join(["Straßenbahn straßenbahm"] * 20_000) + " " + "ab" * 50_000
    docs = [(1, None), (2, ""), (None, "Hello hello HELLO hellO"), (3, "Hello, hallo hallo HALLO"), (3, "Hello, hallo hallo HALLO"), (4, long), (5, "日本 naïve NAÏVE naÏve naïve-naïve"), (6, "ab" * 50_000), (7, "ab" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    expected = brute(counts(docs))
    assert rows(spelling.spelling_variants(df)) == expected and any(len(r[0]) > 1000 for r in expected)
    assert rows(spelling.spelling_variants(df.limit(0))) == []
    assert rows(spelling.spelling_variants(df.where("text is null or text = ''"))) == []


def test_ties_and_chains(spark):
    words = {"worda": 3, "wordb": 9, "wordc": 9, "words": 40, "wordss": 90, "wordsss": 200, "other": 5}
    got = {r[0]: r for r in rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert sorted(got.values()) == brute(words)
    assert got["worda"][1:3] == ("words", "wordsss") and got["other"][1:3] == (None, "other")
