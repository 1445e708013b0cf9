"""Line dedup and similarity join against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import chosen_path, line_dedup
from seqloom.llm.components import components

WORDS = [f"w{i}" for i in range(300)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def dedup_brute(rows, min_chars=40, min_docs=5):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    key = lambda x: x.strip(" \t\n\v\f\r").translate(low)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key(x), i if i is not None else -(2**63)) == (i if i is not None else -(2**63))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def dedup_rows():
    rng = random.Random(2)
    shared = [f"shared line number {i} of many words that goes on and on" for i in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice(["  {}\t", "{}", "\v{} "]).format(rng.choice([s, s.upper()])) if rng.random() < 0.5 else f"own line {i} {j} " + "x" * rng.randint(0, 60) for j, s in enumerate(rng.choices(shared[: rng.choice([1, 4, 12])], k=rng.randint(1, 9)))]
        rows.append((i, "\n".join(lines)))
    rows += [(7, rows[7][1]), (7, "other\n" + shared[0]), (None, shared[0] + "\n" + shared[0]), (None, None), (500, ""), (501, "É" * 39 + "x"), (502, "\n".join([shared[1]] * 3000))]
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = dedup_rows()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, keep string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digest(df).collect()), key=repr)
    assert got == dedup_brute(rows)
    texts = line_dedup.drop_lines(df)
    assert texts.columns == df.columns and texts.count() == len(rows) and texts.where("text is null").count() == 1
    assert line_dedup.line_dedup_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("cuts", [[], [40], [5, 6, 7, 60, 61]])
def test_stream_over_any_partitions(size, cuts):
    """Keys that cross batches and partitions are settled as in one piece."""
    import pyarrow as pa

    rng = random.Random(size)
    rows = sorted(((rng.choice([1, 1, 1, 2, 3, 9]), 0, rng.randrange(12), 0, rng.randrange(3)) for _ in range(90)), key=lambda r: (r[0], -r[2], r[4]))
    bounds = [0, *cuts, len(rows)]
    for b in range(1, len(bounds) - 1):  # equal (key, doc) stay in one partition
        while 0 < bounds[b] < len(rows) and rows[bounds[b]][:3] == rows[bounds[b] - 1][:3]:
            bounds[b] += 1
    names = ("h1", "h2", "doc", "body", "pos")
    dropped, opened, totals = [], [], {}
    for a, b in zip(bounds, bounds[1:]):
        part = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : min(i + size, b)])], names=names) for i in range(a, b, size)]
        for out in line_dedup.stream(iter(part), 5):
            for r in out.to_pylist():
                if r["kind"] == line_dedup.SUMMARY:
                    n, top = totals.get(r["h1"], (0, -1))
                    totals[r["h1"]] = (n + r["n"], max(top, r["doc"]))
                else:
                    (dropped if r["kind"] == line_dedup.DROPPED else opened).append((r["h1"], r["doc"], r["pos"]))
    dropped += [r for r in opened if totals[r[0]][0] >= 5 and r[1] != totals[r[0]][1]]
    docs = {k: {r[2] for r in rows if r[0] == k} for k in {r[0] for r in rows}}
    expected = [(r[0], r[2], r[4]) for r in rows if len(docs[r[0]]) >= 5 and r[2] != max(docs[r[0]])]
    assert sorted(dropped) == sorted(expected)


def test_bitmaps(spark):
    rng = random.Random(4)
    cases = [(n, sorted(rng.sample(range(n), rng.randint(1, n)))) for n in (1, 2, 7, 8, 9, 60, 500) for _ in range(8)]
    df = spark.createDataFrame([(n, drop, "\n".join(f"l{i}" for i in range(n))) for n, drop in cases], "n int, p array<int>, text string")
    for r in df.withColumn("runs", line_dedup.runs_of(F.col("p"))).withColumn("kept", line_dedup.kept_lines(F.col("text"), F.col("runs"))).collect():
        bits = [b for i, n in enumerate(r.runs) for b in [i % 2 == 0] * n]
        assert [i for i, b in enumerate(bits) if not b] == r.p and all(r.runs[1:])
        assert r.kept == "\n".join(f"l{i}" for i in range(r.n) if i not in set(r.p))


def test_line_dedup_with_clashing_names(spark):
    rows = dedup_rows()
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    extra = plain.selectExpr("doc_id as doc", "text", "doc_id as body", "'k' as KEEP", "1 as n_dropped", "2 as dedup_doc", "3 as `a.b`", "doc_id as _doc")
    got = line_dedup.drop_lines(extra, id_col="doc")
    assert got.columns == extra.columns
    assert sorted(map(repr, got.select("doc", "text").toDF("doc_id", "text").collect())) == sorted(map(repr, line_dedup.drop_lines(plain).collect()))


def test_a_long_text_of_repeated_lines(spark):
    """Splitting and dropping is linear: 200,000 lines of which every second one goes."""
    line = "a repeated line that is long enough to count as such"
    long = "\n".join(x for i in range(100_000) for x in (f"own {i}", line))
    df = spark.createDataFrame([(0, long), *[(i, line) for i in range(1, 6)]], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup_digest(df).collect()}
    assert got == {0: (200_000, 100_000), **{i: (1, 1) for i in range(1, 5)}, 5: (1, 0)}


def near_rows():
    rng = random.Random(3)
    rows = []
    for i in range(150):
        rows.append((i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 90)))))
    base = [rng.choice(WORDS) for _ in range(120)]
    for i in range(300, 420):  # a large group of near copies
        words = list(base)
        words[rng.randrange(120)] = "changed"
        rows.append((i, " ".join(words)))
    for i in range(500, 560):  # pairs about the threshold
        words = rows[i - 500][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, "  ".join(words)))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows += [(600 + i, passage + " " + " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(60)]
    rows += [(700, ""), (701, None), (702, " \n"), (None, "a lone text of no known id whatever"), (3, rows[3][1]), (800, "one two"), (801, "one\ttwo"), (802, "w1 " * 20_000)]
    return rows


def near_brute(rows):
    def shingles(t):
        w = chosen_path.WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and (sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9))] for i in range(n)]
    out, seen = {}, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += link[x]
        seen |= group
        low = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        for x in group:
            out[x] = (low, sum(sets[x] == s for s in sets), len(link[x]))
    return [(rows[x][0], *out[x]) for x in range(n)]


@pytest.mark.parametrize("pivots,block", [(512, 128), (3, 16)])
def test_join_equals_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(chosen_path, "MAX_PIVOTS", pivots)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, node string")
    got = sorted(((r.doc, r.class_id, r.n_copies, r.n_links) for r in chosen_path.near_duplicates(df).collect()), key=repr)
    assert got == sorted(near_brute(rows), key=repr)
    if pivots == 512:
        kept = chosen_path.keep_first(df)
        assert kept.columns == df.columns
        classes = {r[1] for r in near_brute(rows)}
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c for c in classes if c is not None)
        assert kept.where("doc_id is null").count() == 1


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    rows = [(3, "alpha beta gamma delta epsilon zeta"), (3, "one two three four five six"), (7, "alpha beta gamma delta epsilon zeta"), (3, "one two three four five six"), (None, "quite another text of six words"), (None, "and one more of many other words")]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, doc int, near_key int")
    kept = chosen_path.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted({(3, rows[0][1]), (3, rows[1][1]), rows[4], rows[5]}, key=repr)
    found = chosen_path.near_duplicates(df).collect()
    assert len(found) == 6 and len({(r.class_id, r.class_text) for r in found}) == 4


def test_join_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert chosen_path.near_duplicates(df).count() == 0 and chosen_path.keep_first(df).count() == 0


def test_recall_of_candidates():
    """Pairs at the threshold share a bucket as often as the number of runs is chosen for."""
    rng = np.random.default_rng(5)
    met, trials = 0, 400
    for _ in range(trials):
        both = rng.integers(0, 2**64, 320, dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, rng.integers(0, 2**64, 40, dtype=np.uint64)])), np.unique(np.concatenate([both, rng.integers(0, 2**64, 40, dtype=np.uint64)]))
        x, y = chosen_path.first_paths(np.stack([chosen_path.signature(a), chosen_path.signature(b)]), chosen_path.runs_for())
        met += bool(np.intersect1d(x, y).size)
    assert met / trials > 0.98


def test_bucket_over_partitions(spark, monkeypatch):
    """In one diverse bucket over several tasks, near copies far apart in the order of nodes are found."""
    monkeypatch.setattr(chosen_path, "MAX_PIVOTS", 25)
    monkeypatch.setattr(chosen_path, "FAN", 12.0)  # so that a split itself loses no pair
    rng = np.random.default_rng(6)
    first = rng.integers(0, 256, (200, chosen_path.COORDS), dtype=np.uint8)
    second = first.copy()
    second[:, ::8] = rng.integers(0, 256, second[:, ::8].shape, dtype=np.uint8)  # 0.875 of the coordinates stay
    sketches = np.concatenate([first, second])
    order = [*range(200), *range(399, 199, -1)]  # a range's first member has its copy last in another range
    rows = [(order[i].to_bytes(4, "big"), s.tobytes(), [1]) for i, s in enumerate(sketches)]
    nodes = spark.createDataFrame(rows, "node binary, sketch binary, paths array<long>")
    parent = {r[0]: r[0] for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight ranges, whatever their size
    try:
        edges = chosen_path.near_edges(nodes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for a, b in edges:
        parent[top(bytes(a))] = top(bytes(b))
    assert [i for i in range(200) if top(rows[i][0]) != top(rows[200 + i][0])] == []


def test_recall_where_buckets_split(spark, monkeypatch):
    """Pairs of similarity about the threshold, in documents that all share a passage, so that buckets split again."""
    monkeypatch.setattr(chosen_path, "MAX_PIVOTS", 8)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(250):
        own = passage + rng.choices(vocabulary, k=90)
        other = list(own)
        for _ in range(rng.choice([1, 2, 3])):
            other[rng.randrange(60, 150)] = "changed"
        rows += [(i, " ".join(own)), (1000 + i, " ".join(other))]
    got = {r.doc: r.n_links for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = {r[0]: r[3] for r in near_brute(rows)}
    assert sum(exact.values()) > 400
    assert sum(got.values()) >= 0.99 * sum(exact.values()) and all(got[i] <= n for i, n in exact.items())


def test_many_pivots_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "MAX_PIVOTS", 4)
    rng = np.random.default_rng(9)
    sketches = rng.integers(0, 256, (60, chosen_path.COORDS), dtype=np.uint8)
    sketches[30:] = sketches[:30]
    rows = [(p, bytes([p, i]), s.tobytes()) for p in (1, 2) for i, s in enumerate(sketches)]
    edges = chosen_path.in_cells(spark.createDataFrame(rows, "path long, node binary, sketch binary"), chosen_path.MEET).collect()
    assert {tuple(sorted((bytes(a), bytes(b)))) for a, b in edges} == {(bytes([p, i]), bytes([p, 30 + i])) for p in (1, 2) for i in range(30)}


def test_pivots_of_absorbed_pairs_meet(spark, monkeypatch):
    """Pairs at the threshold, both members of which were absorbed below a split, by pivots of different partitions: the pivots
    are 0.4 alike, and others at random nearly not at all."""
    rng = np.random.default_rng(10)
    rows, expected = [], set()
    for i in range(40):
        chain = [rng.integers(0, 256, chosen_path.COORDS, dtype=np.uint8)]
        places = rng.permutation(chosen_path.COORDS)
        for k in range(3):  # pivot, member, member, pivot: 0.8 alike each, and nothing changes twice
            step = chain[-1].copy()
            at = places[26 * k : 26 * k + 26]
            step[at] += rng.integers(1, 256, 26, dtype=np.uint8)
            chain.append(step)
        alike = int((chain[0] == chain[3]).sum())
        p, q = bytes([0, i]), bytes([1, i])
        rows += [(1, p, chain[0].tobytes()), (1, q, chain[3].tobytes())]
        if alike >= chosen_path.DEEP_MEET * chosen_path.COORDS:
            expected.add((p, q))
    cells = lambda meet: {tuple(sorted((bytes(a), bytes(b)))) for a, b in chosen_path.in_cells(spark.createDataFrame(rows, "path long, node binary, sketch binary"), meet).collect()}
    assert len(expected) >= 39 and cells(chosen_path.DEEP_MEET) == expected and len(cells(chosen_path.MEET)) < 39


def test_recall_where_members_are_absorbed(spark, monkeypatch):
    """A low bound of absorption, so that many members are represented by pivots where buckets split."""
    monkeypatch.setattr(chosen_path, "MAX_PIVOTS", 8)
    monkeypatch.setattr(chosen_path, "ABSORB", 0.80)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(120):
        own = passage + rng.choices(vocabulary, k=90)
        rows.append((i, " ".join(own)))
        for j in (1, 2):
            other = list(own)
            for _ in range(rng.choice([1, 2])):
                other[rng.randrange(60, 150)] = f"changed{rng.randrange(9)}"
            rows.append((1000 * j + i, " ".join(other)))
    got = {r.doc: r.n_links for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = {r[0]: r[3] for r in near_brute(rows)}
    assert sum(exact.values()) > 400 and all(got[i] <= n for i, n in exact.items())
    assert sum(got.values()) >= 0.99 * sum(exact.values())


def test_runs_grow_with_the_level():
    assert [chosen_path.runs_for(levels=n) for n in (2, 3, 4, 6)] == sorted(chosen_path.runs_for(levels=n) for n in (2, 3, 4, 6))
    assert chosen_path.runs_for(levels=2) == 9 and chosen_path.runs_for(levels=4) >= 25
