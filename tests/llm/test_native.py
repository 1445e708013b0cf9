"""Mixing and quality rules: schedules, bounds, SQL equivalents, and plans without Python."""

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from seqloom import storage
from seqloom.llm import mixing, quality_rules
from seqloom.llm.queries import ORACLES, QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare.differences(spark, QUERIES[name], ORACLES[name], SF) == []


def worst_lag(spark, case):
    """The largest distance in blocks between what a source has had and its target, at any slot, of (source, quanta, g)."""
    rows = mixing.schedule(spark.createDataFrame(case, "source string, quanta long, g long")).orderBy("slot").collect()
    total, had, worst = sum(c[2] for c in case), {c[0]: 0 for c in case}, 0.0
    weight = {c[0]: c[2] / total for c in case}
    assert len({r.slot for r in rows}) == len(rows) == sum(c[1] for c in case if c[2])
    for r in rows:  # between its own slots a source's distance lies between these
        assert r.nth == had[r.source]
        worst = max(worst, abs(r.nth - weight[r.source] * r.slot), abs(r.nth + 1 - weight[r.source] * (r.slot + 1)))
        had[r.source] += 1
    return worst / mixing.LEVELS


def test_no_source_is_a_block_off_its_target(spark):
    rng = random.Random(1)
    assert worst_lag(spark, [("a", 5, 1)]) == 0
    assert worst_lag(spark, [("a", 41_421, 10**12), ("b", 58_579, int(2**0.5 * 10**12))]) < 1  # 100,000 slots
    assert worst_lag(spark, [(f"s{i}", rng.randint(1, 60), rng.randint(1, 10**9)) for i in range(25)]) < 1
    many = [(f"s{i}", int(rng.paretovariate(1)) + 1) for i in range(5000)]
    assert worst_lag(spark, [(s, q, q * 10**7 + rng.randrange(10**6)) for s, q in many]) < 1


def test_far_weights_end(spark):
    """A weight of 1e-11 spreads 50 quanta over 5e12 slots: a larger fan, and no more frames than quanta."""
    one = 1 << 40
    for share in (1e-6, 1e-11):
        rows = mixing.schedule(spark.createDataFrame([("a", 50, one), ("b", 50, max(1, round(one * share)))], "source string, quanta long, g long")).orderBy("slot").collect()
        assert len({r.slot for r in rows}) == 100
        for source in "ab":
            own = [r for r in rows if r.source == source]
            assert [r.nth for r in own] == list(range(50))
            assert all(abs(r.nth - r.g * r.slot / r.total) < mixing.LEVELS for r in own)
    docs = spark.createDataFrame([(i, "t", "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    assert mixing.place_documents(docs, {"a": 1.0, "b": 1e-11}).select("mix_slot").distinct().count() == 100


def test_places(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else rng) for i, rng in ((i, f"s{i % 7}") for i in range(900))]
    rows += [(None, "n1", None), (None, None, None), (5000, None, None), (1, "t1", "hot"), (10**12, "far", "hot")] + [(6000 + i, "rare", f"rare{i}") for i in range(5)]
    df = spark.createDataFrame([(*r, "m", 7) for r in rows], "doc_id long, text string, source string, MIX_block string, mix_rank int")
    weights = {"hot": 3.0, "s0": 1.0, "s3": 2.0**0.5, "s6": 1.0, "": 0.5, "rare0": float("nan"), "rare1": -1.0, "rare2": 0.0}
    placed = mixing.place_documents(df, weights=weights)
    names = mixing.new_names(df, *mixing.PLACE)
    assert placed.columns == [*df.columns, *names] and names[0] == "_mix_block"
    got = [dict(zip(("doc_id", "text", "source", "own", "rank", "block", "seq", "slot", "release", "deadline"), r)) for r in placed.collect()]
    assert len(got) == len(rows) and {r["own"] for r in got} == {"m"} and {r["rank"] for r in got} == {7}
    assert len({(r["slot"], r["block"], r["seq"]) for r in got}) == len(rows)
    for source in {r["source"] for r in got}:
        own = sorted((r for r in got if r["source"] == source), key=lambda r: (r["block"], r["seq"]))
        assert [(r["block"], r["seq"]) for r in own] == [(i // 8, i % 8) for i in range(len(own))]
        assert [r["slot"] for r in own] == sorted(r["slot"] for r in own)
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert ids == sorted(ids) and all(r["doc_id"] is not None for r in own[: len(ids)])
    width = sum((3.0, 1.0, 2.0**0.5, 1.0, 0.5))
    for r in got:  # a block's rows lie within a block's time of its ideal times
        w = weights.get(r["source"] or "", 0.0)
        if w > 0:
            assert r["release"] - 4 * width / w <= r["slot"] < r["deadline"] + 4 * width / w
        else:
            assert r["release"] is None and r["slot"] > max(x["slot"] for x in got if weights.get(x["source"] or "", 0.0) > 0)
    mixed = mixing.in_mix_order(df, weights=weights)
    assert mixed.columns == df.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, df.collect()))
    assert mixing.place_documents(df.limit(0)).count() == 0
    assert mixing.place_documents(df, weights={}).count() == len(rows)


def test_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 5, 60, 400, 3000) for k in range(0, max(1, n // 50) + 1, 3)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality_rules.tail(F.col("n"), F.col("k"), 0.02))
    for r in df.collect():
        exact = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k <= 0.02 * r.n else 1.0
        assert r.p == pytest.approx(exact, rel=1e-8)


def plain_counts(text):
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n\v\f\r", "a b c a b c", "a b c a b c a", "é\n#*$\n#*$\n é", "a " * 30_000, "x\x1cy \x85 z"]
    texts += ["".join(rng.choice("ab \n#|") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    for r in quality_rules.measures(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])


def test_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(60)), "en" if i else None))
        labels.append((i, 0 if bad else 1))
    rows += [(9000, None, "en"), (9001, "few words", "en"), (None, " ".join(word() for _ in range(60)), "xx"), (9002, " ".join(word() for _ in range(60)), "en"), (9002, rows[-1][1], "en")]
    labels += [(5, 1), (7, None), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rules.judge(df, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[9000].base_failed and by[9001].base_failed and not by[9001].kept and by[None].kept and by[9002].kept
    english = [by[i] for i in range(1, 3000)]
    assert sum(not r.kept for r in english if r.doc_id % 10) <= 27 and not any(r.kept for r in english if not r.doc_id % 10)
    assert by[0].kept  # its stratum (null) has no holdout
    assert quality_rules.judge(df.limit(0), lab).count() == 0
    assert sum(r.kept for r in quality_rules.judge(df, lab.limit(0)).collect()) == sum(not r.base_failed for r in got)


@pytest.mark.parametrize("name", ["op9_pfair_mix", "op10_quality_rules"])
def test_plans_hold_no_python(spark, name, monkeypatch):
    """Neither the query's plan nor any plan that a checkpoint cuts off has a Python worker."""
    plans = []
    cut = storage.checkpoint

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return cut(df)

    monkeypatch.setattr(storage, "checkpoint", seen)
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().toString())
    assert len(plans) > 1 and not any(x in plan for plan in plans for x in ("Python", "Pandas", "InArrow", "BatchEval"))
