"""Operators against literal cases and plain restatements."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.config import Options, parse
from seqloom.functions import damage as fn
from seqloom.functions import sequence as sq
from seqloom.functions.special import erfc_sql
from seqloom.operators import align, damage, em, kmers, matrix, pairs, profiles, qc, report

DNA = st.text("ACGTN", min_size=0, max_size=80)


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_kmer_counts():
    assert {i: n for i, n in enumerate(kmers.count_matrix(["ACGT"], 2)[0]) if n} == {1: 1, 6: 1, 11: 1}
    assert {i: n for i, n in enumerate(kmers.count_matrix(["ACNGT"], 2)[0]) if n} == {1: 1, 11: 1}
    assert kmers.count_matrix(["", "A", "acgt"], 2).sum(axis=1).tolist() == [0, 0, 3]


def test_kmer_frequencies_keep_other_windows_in_the_denominator():
    assert kmers.frequency_matrix(["ACNGT"], 2)[0].sum() == pytest.approx(0.5)
    assert kmers.frequency_matrix(["acgt"], 2)[0].sum() == 0


def test_likelihood():
    p = np.array([0.4, 0.3, 0.1, 0.2])
    got = profiles.log_likelihood(np.array([[10, 5, 0, 3]]), np.log(p)[None, :])[0, 0]
    assert got == pytest.approx(10 * math.log(0.4) + 5 * math.log(0.3) + 3 * math.log(0.2), abs=1e-10)


def test_divergence():
    flat = np.full(4, 0.25)
    assert profiles.jsd(flat, flat) < 1e-10
    assert 0.5 < profiles.jsd(np.array([0.9, 0.1, 0, 0]), np.array([0, 0, 0.1, 0.9])) <= math.log(2) + 1e-10
    a, b = np.array([0.6, 0.2, 0.1, 0.1]), np.array([0.1, 0.1, 0.2, 0.6])
    assert profiles.jsd(a, b) == pytest.approx(profiles.jsd(b, a), abs=1e-10)


def test_gc_spread():
    assert np.std([0.66] * 50 + [0.51] * 50) > 0.03 > np.std([0.505 + 0.0001 * i for i in range(100)])


def test_two_means_splits(spark):
    a, b = [20.0, 15.0, 10.0, 5.0] + [0.0] * 12, [0.0] * 12 + [20.0, 15.0, 10.0, 5.0]
    rows = spark.createDataFrame([(i, a if i < 10 else b) for i in range(20)], "read_idx long, x array<double>")
    got = {r.read_idx: r.cluster for r in matrix.two_means(rows).collect()}
    assert len({got[i] for i in range(10)}) == 1 and {got[i] for i in range(10)} != {got[i] for i in range(10, 20)}


def test_merge_lowers_bic():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(16))
    sums = np.stack([rng.multinomial(500, p), rng.multinomial(500, p), rng.multinomial(500, rng.dirichlet(np.ones(16)))]).astype(float)
    assert profiles.merge_step(sums, 300) == (0, 1)
    assert profiles.merge_step(sums[:1], 300) is None


def test_em_finds_two_groups(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("AAAT" if i % 2 else "GGGC") for _ in range(60)), (i // 7) % 4) for i in range(80)]
    reads = spark.createDataFrame(rows, "read_idx long, seq string, cluster int")
    model = em.em(reads, min_cluster_size=10)
    got = {r.read_idx: r.cluster for r in em.assignments(reads, model).collect()}
    assert len({got[i] for i in range(0, 80, 2)}) == 1 and got[0] != got[1]
    assert len(model.profiles) == 2 and model.profiles.sum(axis=1) == pytest.approx([1, 1])


def test_k_means_and_components(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (30, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "read_idx long, x array<double>")
    got = {r.read_idx: r.cluster for r in matrix.k_means(rows, 2).collect()}
    assert len({got[i] for i in range(30)}) == 1 and got[0] != got[59]
    assert matrix.covariance(rows) == pytest.approx(np.cov(x.T))
    projected, retained, every = matrix.principal_components(rows, 2)
    assert every == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    own = np.array([r.x for r in projected.orderBy("read_idx").collect()])
    assert np.abs(own) == pytest.approx(np.abs((x - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]), abs=1e-8)
    z = np.array([r.x for r in matrix.z_scores(rows).orderBy("read_idx").collect()])
    assert z == pytest.approx((x - x.mean(axis=0)) / x.std(axis=0))


def test_erfc(spark):
    xs = [x / 7 for x in range(-40, 41)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(erfc_sql("x")).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(x) for x in xs], rel=1e-12)


def test_ids(spark):
    cases = {"a/1": ("a", 1), "a.2": ("a", 2), "a_1": ("a", 1), "a-2": ("a", 2), "a:1": ("a", 1), "a#2": ("a", 2), "a.pair.1": ("a.pair", 1), "s_R1_001": ("s_001", 1), "x_1_y": ("x_y", 1), "x_1_10_y": ("x_1_10_y", 0), "a_1b_1": ("ab", 1), "plain": ("plain", 0)}
    rows = spark.createDataFrame([(c,) for c in cases], "id string").select("id", sq.base_id(F.col("id")), sq.mate(F.col("id"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_sequence_edges(spark):
    df = spark.createDataFrame([("",), ("N",), ("acgtNx",), ("GgCc",)], "seq string")
    rows = df.select(sq.gc_content(F.col("seq")), sq.norm_length(F.col("seq")), sq.reverse_complement(F.col("seq"))).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, pytest.approx(2 / 6), 1.0]
    assert [r[2] for r in rows] == ["", "N", "NNacgt", "gGcC"]


@settings(max_examples=60, deadline=None)
@given(st.lists(DNA, min_size=1, max_size=6))
def test_change_points_agree_with_a_plain_scan(seqs):
    n = np.array([len(s) for s in seqs])
    code, _ = damage.segments(seqs, n, 5)
    place, _, pvalue, _ = damage.change_arrays(code, n, damage.T)
    for s, k, p in zip(seqs, place, pvalue):
        best, at = 0.0, -1
        for c in range(3, len(s) - 2):
            stat = abs(s[:c].count("T") / c - s[c:].count("T") / (len(s) - c)) * math.sqrt(c * (len(s) - c) / len(s))
            if stat > best + 1e-15:
                best, at = stat, c
        assert k == at and 0 <= p <= 1


def fit(sites, rate):
    if not sites or rate <= 0:
        return 0.0, 0.0
    pred = [math.exp(-rate * i) for i, _ in sites]
    total = sum(p for _, p in sites)
    rmse = math.sqrt(sum((q - p) ** 2 for q, (_, p) in zip(pred, sites)) / len(sites))
    return total / sum(pred), max(0.0, 1 - rmse / (total / len(sites)))


def plain_sites(seg, five):
    out = []
    for i, b in enumerate(seg):
        if five and b == "T":
            out.append((i, 0.85 if seg[i + 1 : i + 2] == "G" else 0.75 if i < 3 else 0.65 if i < 6 else 0.5))
        elif five and b == "C":
            out.append((i, 0.1))
        elif not five and b in "AG":
            d, c = len(seg) - i - 1, i > 0 and seg[i - 1] == "C"
            out.append((i, (0.8 if c else 0.75 if d == 0 else 0.65 if d < 3 else 0.55 if d < 6 else 0.45) if b == "A" else 0.18 if c else 0.14 if d < 3 else 0.07))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", min_size=10, max_size=16), st.booleans())
def test_fits_agree_with_plain_searches(seg, five):
    sites = plain_sites(seg, five)
    prob = damage.site_probabilities(*damage.segments([seg], np.array([len(seg)]), 5), 5 if five else 3)
    assert [(i, float(p)) for i, p in enumerate(prob[0]) if p > 0] == sites
    low, high, best = 0.01, 2.0, (0.0, 0.0)
    for _ in range(8):
        m1, m2 = low + (high - low) / 3, high - (high - low) / 3
        f1, f2 = fit(sites, m1)[1], fit(sites, m2)[1]
        if f1 > f2:
            high = m2
            best = (m1, f1) if f1 > best[1] else best
        else:
            low = m1
            best = (m2, f2) if f2 > best[1] else best
    rate, _, quality = damage.ternary_fit(prob)
    assert (rate[0], quality[0]) == pytest.approx(best if len(sites) >= 3 else (0, 0), abs=1e-6)
    low, high, out = 0.05, 2.5, None
    while high - low > 0.01:
        mid = (low + high) / 2
        at = fit(sites, mid)[1]
        if fit(sites, mid - 0.05)[1] > at:
            high = mid
        elif fit(sites, mid + 0.05)[1] > at:
            low = mid
        else:
            out = mid
            break
    assert damage.hill_fit(prob)[0] == pytest.approx(out if out is not None else (low + high) / 2, abs=1e-6)


def test_paths_of_assessment():
    got = damage.assess(["A" * 10, "ACGT" * 30, "TTTTTCCCCCAAAAAGGGGGTCTCTCAGAGAGAG" + "T" * 10])
    assert got["path"].tolist()[:2] == ["short", "fast"] and got["combined"][0] == 0.1


def test_fast_path_agrees_with_the_column_form(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(100, 260))) for _ in range(40)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_idx long, seq string")
    column = {r.read_idx: (r.damage5, r.damage3, r.combined) for r in damage.fast_damage(reads).collect()}
    dense = damage.assess(seqs)
    for i in range(40):
        assert column[i] == pytest.approx((dense["damage5"][i], dense["damage3"][i], dense["combined"][i]))


def test_weights_collapse(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 15))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for end, letters in ((5, "Tt"), (3, "Aa")):
        rows = df.select(fn.position_weight(F.col("s"), letters).alias("a"), fn.position_weight_literal(F.col("s"), end).alias("b")).collect()
        assert all(r.a == pytest.approx(r.b) for r in rows)


def test_pairs(spark):
    seq = "ACGTACGTACGTACGTACGT"
    other = "C" + seq[1:]
    rc = one(spark, sq.reverse_complement(F.col("s")), s=other)
    reads = spark.createDataFrame([("T" + "r/1", "T" + seq[1:]), ("T" + "r/2", rc), ("lone/1", seq), ("odd", seq)], "id string, seq string")
    summary = pairs.pair_summary(pairs.mate_join(reads)).collect()
    assert len(summary) == 1 and (summary[0].c_to_t, summary[0].other) == (1, 0) and summary[0].support == 1.0
    assert {r.id: r.support for r in pairs.support_of_reads(reads).collect()} == {"Tr/1": 1.0, "Tr/2": 1.0, "lone/1": 0.5, "odd": 0.5}
    assert tuple(pairs.pair_counters(reads).first()) == (4, 2, 3, 1, 2, 1, 1)


def test_short_overlap(spark):
    reads = spark.createDataFrame([("a/1", "ACGT"), ("a/2", "ACGT")], "id string, seq string")
    got = pairs.pair_summary(pairs.mate_join(reads)).first()
    assert not got.has_overlap and got.support == 0.0 and got.overlap_size == 0


def test_alignment_filters(spark):
    rows = [(0, "A" * 40), (0x100, "A" * 40), (0x800, "A" * 40), (4, "A" * 40), (0, "A" * 9)]
    df = spark.createDataFrame(rows, "flag int, seq string")
    got = qc.alignment_counters(df).first().asDict()
    assert got == {"total": 5, "mapped": 4, "unmapped": 1, "secondary": 1, "supplementary": 1, "short": 1, "passed": 2}
    assert qc.passed_alignments(df, "mapped").count() == 1 and qc.passed_alignments(df, "unmapped").count() == 1


def test_consistency(spark):
    reads = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    counts, missing = qc.consistency_report(reads, gc=reads.where("id > '0'"), damage=reads.where("id < '4'"))
    assert counts.first().asDict() == {"reads": 5, "kept": 3, "missing_gc": 1, "missing_damage": 1}
    assert {r.id for r in missing.collect()} == {"0", "4"}


def test_n50(spark):
    got = report.contig_stats(spark.createDataFrame([(n,) for n in (100, 50, 30, 20)], "length int")).first()
    assert (got.contigs, got.shortest, got.longest, got.mean, got.total, got.n50) == (4, 20, 100, 50.0, 200, 100)


def test_enumerate(spark):
    assert [r.kmer for r in kmers.enumerate_kmers(spark, 0).collect()] == [""]
    assert [r.kmer for r in kmers.enumerate_kmers(spark, 2).orderBy("kmer_idx").collect()][:5] == ["AA", "AC", "AG", "AT", "CA"]


def test_options():
    got = parse(["--fastq", "x.fq", "--em-iterations", "many", "--k", "5", "--legacy"])
    assert (got.em_iterations, got.k, got.legacy, got.pca_components) == (20, 5, True, 8)
    for bad in (Options(), Options(fastq="a", bam="b"), Options(fastq="a", pca_components=21)):
        with pytest.raises(ValueError):
            bad.checked()


def test_ensemble_weighs_mates(spark):
    from seqloom.plans.queries.damage import ensemble_damage

    got = {r.id: r for r in ensemble_damage(spark, "/root/testdata/sf0.001").limit(2000).collect()}
    # Three weights of nine decimals each.
    assert got and all(abs(r.w_change + r.w_model + r.w_pair - 1) < 1.6e-9 for r in got.values())
    assert sum(r.w_pair > 0 for r in got.values()) > len(got) / 2


def test_pair_evidence(spark):
    seq = "T" + "ACGT" * 7 + "A"
    mate = ("C" + seq[1:-1] + "G")[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("a/1", seq), ("a/2", mate), ("b", seq)], "id string, seq string")
    got = {r.id: r for r in pairs.with_evidence(reads).collect()}
    assert all((got[i].ratio, got[i].mismatches, got[i].overlap_size) == (1.0, 2, 30) for i in ("a/1", "a/2"))
    assert got["b"].ratio is None and got["b"].support is None


def test_counts_in_the_batch_equal_plain_ones(spark):
    seqs = ["", "ACG", "acgtnACGT", "ACGTACGTACGTTT", "NNNN", "GATTACA" * 30, "ACGxACGTA"]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_idx long, seq string")
    for k in (2, 5):
        plain, shares = {}, {}
        for i, s in enumerate(seqs):
            for j in range(len(s) - k + 1):
                w = s[j : j + k]
                if set(w.upper()) <= set("ACGT"):
                    key = (i, sum("ACGT".index(c) * 4 ** (k - 1 - p) for p, c in enumerate(w.upper())))
                    plain[key] = plain.get(key, 0) + 1
                if set(w) <= set("ACGT"):
                    shares[i, w] = shares.get((i, w), 0) + 1 / (len(s) - k + 1)
        assert {(r.read_idx, r.kmer_idx): r.n for r in kmers.kmer_counts(df, k).collect()} == plain
        assert {(r.read_idx, r.kmer): r.freq for r in kmers.kmer_frequencies(df, k).collect()} == pytest.approx(shares)
    codons = {}
    for i, s in enumerate(seqs):
        for j in range(0, len(s) - 2, 3):
            codons[i, s[j : j + 3]] = codons.get((i, s[j : j + 3]), 0) + 1 / (len(s) // 3)
    assert {(r.read_idx, r.codon): r.freq for r in kmers.codon_usage(df).collect()} == pytest.approx(codons)
    assert kmers.kmer_counts(df.limit(0), 4).count() == 0


def test_em_of_longer_kmers(spark):
    rng = np.random.default_rng(4)
    draw = lambda p: "".join(rng.choice(list("ACGT"), 120, p=p))
    rows = [(i, draw([0.4, 0.1, 0.1, 0.4] if i % 2 else [0.1, 0.4, 0.4, 0.1]), i % 2) for i in range(60)]
    model = em.em(spark.createDataFrame(rows, "read_idx long, seq string, cluster int"), k=5)
    assert model.profiles.shape == (2, 4**5)
    got = {r.read_idx: r.cluster for r in em.map_reads(spark.createDataFrame(rows, "read_idx long, seq string, cluster int"), model).collect()}
    assert [got[i] for i in range(60)] == [i % 2 for i in range(60)]


def test_scaled_components_equal_those_of_z_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 10, 100, 1, 1, 0] + 7
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "read_idx long, x array<double>").repartition(5)
    a, ra, ea = matrix.principal_components(rows, 3, scaled=True)
    b, rb, eb = matrix.principal_components(matrix.z_scores(rows), 3)
    np.testing.assert_allclose(ra, rb, atol=1e-9)
    np.testing.assert_allclose(ea, eb, atol=1e-9)
    of = lambda df: np.array([r.x for r in df.orderBy("read_idx").collect()])
    np.testing.assert_allclose(of(a), of(b), atol=1e-8)
    values = np.linalg.eigvalsh(np.cov((x[:, :5] - x[:, :5].mean(axis=0)) / x[:, :5].std(axis=0), rowvar=False))[::-1]
    np.testing.assert_allclose(ea[:5], values, atol=1e-9)


def test_k_means_finds_separate_groups(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "read_idx long, x array<double>")
    got = {r.read_idx: r.cluster for r in matrix.k_means(rows, 4).collect()}
    assert all(len({got[i] for i in range(a, a + 40)}) == 1 for a in range(0, 160, 40)) and len(set(got.values())) == 4


def test_counters_follow_the_order(spark):
    """A read finds its pair only if one of the other mate waits: the first mate of an id waits, also when it comes again."""
    ids = ["a/2", "a/2", "a/1", "a/2", "b/1", "c", "a/1", "a"]
    reads = spark.createDataFrame([(i, x, "ACGT") for i, x in enumerate(ids)], "read_idx long, id string, seq string")
    got = pairs.pair_counters(reads).first().asDict()
    waiting, found = set(), 0
    for x in ids:
        base, _, mate = x.partition("/")
        if mate and (base, "12".replace(mate, "")) in waiting:
            found += 1
        elif mate:
            waiting.add((base, mate))
    assert got == {"lookups": 8, "hits": 6, "inserts": 6, "pair_found": found, "pair_not_found": 6 - found, "unnamed": 2, "alignments": 1}
    assert tuple(pairs.pair_counters(reads.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)


def flipped(s):
    return s[::-1].translate(str.maketrans("ACGTNacgtnx", "TGCANtgcanN"))


def test_mismatches_are_of_standard_bases(spark):
    """A place where either mate has another letter than ACGT does not count."""
    one = "TACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"
    with_n = "N" + one[1:]
    reads = spark.createDataFrame([("a/1", one), ("a/2", flipped(with_n)), ("b/1", with_n[:-1] + "x"), ("b/2", flipped("C" + one[1:-1] + "G"))], "id string, seq string")
    assert pairs.mismatches(pairs.mate_join(reads)).count() == 0
    assert {tuple(r)[3:] for r in pairs.pair_summary(pairs.mate_join(reads)).collect()} == {(0, 0, 0, 0.5)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTNacx", max_size=40), st.text("ACGTNacx", max_size=44), st.lists(st.integers(0, 40), max_size=45), st.lists(st.integers(0, 40), max_size=45)), min_size=1, max_size=4))
def test_places_against_a_plain_scan(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([flipped(r[1]) for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int16())), pa.array([r[3] for r in rows], pa.list_(pa.int16()))], names=["seq1", "seq2", "qual1", "qual2"])
    got = pairs.Places(batch)
    support = got.support()
    seen = sorted(zip(got.pair.tolist(), got.pos.tolist(), got.pattern.tolist()))
    expected = []
    for i, (a, b, q1, q2) in enumerate(rows):
        b = flipped(flipped(b))
        own, weights, near = [], 0.0, 0.0
        for j, (x, y) in enumerate(zip(a.upper(), b.upper())):
            if len(a) < 10 or len(a) > len(b) or not {x, y} <= set("ACGT") or x == y:
                continue
            low, edge = min(10, len(a) // 5), len(a)
            five, three = j < low, j >= edge - low
            kind = 0 if five and x + y == "TC" else 1 if three and x + y == "AG" else 2 if three and x + y == "GA" else 3 if five and x + y == "CT" else 4
            own.append(kind)
            expected.append((i, j, kind))
            if kind < 4:
                q = min(q1[j], q2[j]) if j < len(q1) and j < len(q2) else None
                w = 0.7 if q is None else 1.0 if q > 20 else 0.8 if q > 15 else 0.5
                weights, near = weights + w, near + w * min(1.0, 10 / ((j if kind in (0, 3) else edge - j) + 1))
        total = sum(k in (0, 1, 4) for k in own)
        plain = 0.0 if len(a) < 10 or not b else 0.5 if not total else min(1.0, 0.7 * sum(k < 2 for k in own) / total + 0.3 * (near / weights if weights else 0.5))
        assert support[i] == pytest.approx(plain)
    assert seen == expected


def test_below_fifteen_bases_nothing_changes(spark):
    seqs = ["", "TTTTTTAAAAAA", "TTTTTTTAAAAAAA", "TTTTTTTTTTAAAAAAA", "TTTTTTTTTT" + "GC" * 10 + "GGGGGGGGGG"]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_idx long, seq string")
    got = {r.read_idx: r for r in damage.change_points(df).collect()}
    assert all((got[i].pvalue5, got[i].pvalue3, got[i].score5, got[i].score3, got[i].position5) == (1.0, 1.0, 0.0, 0.0, None) for i in range(3))
    assert (got[3].pvalue5, got[3].score5) == (1.0, 0.1) and got[4].score5 == pytest.approx(0.1 if got[4].position5 is None else got[4].score5)
    parts = damage.ensemble(seqs, *(np.full(5, x) for x in (0.5, 0.0, 0.0, 0.0)))
    assert parts["prob5"][1] == pytest.approx(parts["w_model"][1] * (0.1 + 0.8 * damage.decay_model(seqs, damage.segment_sizes(np.array([len(s) for s in seqs]), 5))["fit5"][1]))


def test_order_of_cuts_in_wide_segments():
    """Equal statistics: from 21 bases the middle place goes first, at any depth."""
    code = np.full((1, 40), damage.G, np.int8)
    assert damage.cuts(2, 18) == list(range(2, 18)) and damage.cuts(2, 3) == []
    order = damage.cuts(2, 38)
    assert order[:2] == [20, 11] and set(order) == set(range(2, 38)) - {k for k in range(2, 38) if k not in order}
    code[0, [0, 39]] = damage.T  # symmetric: the statistic at k equals that at 40 - k
    place, stat, _, _ = damage.change_arrays(code, np.array([40]), damage.T)
    best = max(abs(1 / k - 1 / (40 - k)) * math.sqrt(k * (40 - k) / 40) for k in range(3, 38))
    assert stat[0] == pytest.approx(best) and place[0] == next(k for k in order if k >= 3 and abs(abs(1 / k - 1 / (40 - k)) * math.sqrt(k * (40 - k) / 40) - best) < 1e-15)


def test_em_stops_by_the_present_likelihood():
    """100 to 101 is 1/101 of the present one, which is below 0.00995; of the former it would be 1/100."""
    assert em.relative_change([-100.0, -101.0]) == pytest.approx(1 / 101) and em.relative_change([-100.0, -101.0]) < 0.00995 < 1 / 100
    assert em.relative_change([-101.0, -100.0]) == pytest.approx(1 / 100)
    assert em.relative_change([-3.0, 0.0]) == 3.0


def plain_em(seqs, clusters, k, min_size=10, max_rounds=20, convergence=0.001):
    """Every read compared in every round, every pair of clusters in every merge."""
    counts = kmers.count_matrix(seqs, k)
    names = sorted(c for c in set(clusters) if c >= 0 and clusters.count(c) >= profiles.min_initial_size(min_size))
    labels = np.array([names.index(c) if c in names else -1 for c in clusters])
    model = profiles.smooth(np.array([counts[labels == c].sum(axis=0) for c in range(len(names))]))
    history = []
    for round_ in range(1, max_rounds + 1):
        new = np.round(counts @ np.log(model).T, 6).argmax(axis=1)
        changed = int(((labels != new) & (labels >= 0)).sum()) if round_ == 1 else int((labels != new).sum())
        alive = np.unique(new)
        labels = np.searchsorted(alive, new)
        sums = np.array([counts[labels == c].sum(axis=0) for c in range(len(alive))])
        merged = False
        while len(sums) > 1:
            p = profiles.smooth(sums)
            i, j = min((profiles.jsd(p[a], p[b]), a, b) for a in range(len(p)) for b in range(a + 1, len(p)))[1:]
            joint = np.delete(sums, j, axis=0)
            joint[i] += sums[j]
            ll = lambda s: float((s * np.log(profiles.smooth(s))).sum())
            if profiles.bic_value(ll(joint), len(joint), len(seqs), 4**k) >= profiles.bic_value(ll(sums), len(sums), len(seqs), 4**k):
                break
            sums, merged = joint, True
            labels = np.where(labels == j, i, np.where(labels > j, labels - 1, labels))
        model = profiles.smooth(sums)
        history.append(float((sums * np.log(model)).sum()))
        if round_ >= em.MIN_ROUNDS and not merged and (changed == 0 or em.relative_change(history) < convergence):
            break
    return labels, history, model


def mixed_reads(seed, n=160):
    rng = random.Random(seed)
    kinds = ["AAAT", "GGGC", "ACGT", "AACG"]
    return [(i, "".join(rng.choice(kinds[i % 4]) for _ in range(rng.randint(1, 90))), rng.randint(-1, 6)) for i in range(n)]


@pytest.mark.parametrize("k,seed,convergence", [(2, 1, 0.0), (4, 2, 0.001), (3, 3, 0.0), (6, 4, 0.0)])
def test_em_equals_plain_rounds(spark, k, seed, convergence):
    rows = mixed_reads(seed)
    reads = spark.createDataFrame(rows, "read_idx long, seq string, cluster int")
    labels, history, model = plain_em([r[1] for r in rows], [r[2] for r in rows], k, convergence=convergence)
    got = em.em(reads, k=k, convergence=convergence)
    assert got.history == pytest.approx(history) and got.profiles == pytest.approx(model)
    assert [r.cluster for r in em.assignments(reads, got).orderBy("read_idx").collect()] == labels.tolist()


def test_em_goes_on_from_its_last_round(spark, tmp_path):
    rows = mixed_reads(5)
    reads = spark.createDataFrame(rows, "read_idx long, seq string, cluster int")
    whole = em.em(reads, k=2, convergence=0.0)
    folder = str(tmp_path / "em")
    em.em(reads, k=2, convergence=0.0, max_rounds=3, folder=folder)
    lost = spark.createDataFrame([], "read_idx long, seq string, cluster int")  # not read again
    again = em.em(lost, k=2, convergence=0.0, folder=folder)
    assert again.history == whole.history and (again.profiles == whole.profiles).all()
    assert [r.cluster for r in em.assignments(reads, again).collect()] == [r.cluster for r in em.assignments(reads, whole).collect()]


def test_em_looks_at_fewer_reads(spark):
    """Clear reads are compared in the first rounds only."""
    rows = mixed_reads(6, 400)
    rows = [(i, s, i % 4 if i % 5 else 0) for i, s, _ in rows if len(s) > 40]
    reads = spark.createDataFrame(rows, "read_idx long, seq string, cluster int")
    model, started, sums = em.initialise(reads, 2)
    frame = started.select("seq", F.col("start").cast("int").alias("new"))
    last, relabel, looked = None, np.arange(len(model.sizes)), []
    for _ in range(8):
        frame = spark.createDataFrame(em._round(frame, model, last, relabel).collect(), em.STATE)
        looked.append(frame.where("seen").count())
        own = em._sums(frame.select("seq", F.lit(-1).alias("old"), "new"), 2, len(model.profiles))
        last, model = model, em.Model(profiles.smooth(own[0]), own[1], own[2], 2)
    assert looked[0] == frame.count() and sum(looked) < 0.6 * 8 * looked[0]


def test_merges_equal_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.dirichlet(np.ones(16), 6)
    sums = np.stack([rng.multinomial(300, base[i % 6]) for i in range(24)] + [np.zeros(16, int), np.zeros(16, int)]).astype(float)
    merges, plain = profiles.Merges(sums, np.ones(26), np.zeros(26)), sums
    number = np.arange(26)
    while (pair := merges.step(4000)) is not None:
        p = profiles.smooth(plain)
        i, j = min((profiles.jsd(p[a], p[b]), a, b) for a in range(len(p)) for b in range(a + 1, len(p)))[1:]
        assert pair == (number[i], number[j])
        plain[i] += plain[j]
        plain, number = np.delete(plain, j, axis=0), np.delete(number, j)
    assert 1 < len(plain) < 12 and (merges.left()[0] == plain).all() and merges.left()[1].sum() == 26


def test_wide_counts_equal_dense_ones():
    rng = random.Random(9)
    seqs = ["", "ACG", "N" * 20, *("".join(rng.choice("ACGTacgtN") for _ in range(rng.randint(1, 200))) for _ in range(40))]
    wide = kmers.Counts(seqs, 6)
    assert wide.matrix is None and kmers.Counts(seqs, 5).matrix is not None
    full = kmers.count_matrix(seqs, 6)
    columns = np.random.default_rng(1).normal(size=(3, 4**6))
    assert wide.times(columns) == pytest.approx(full @ columns.T) and (wide.any() == full.any(axis=1)).all()
    sums = np.zeros((3, 4**6))
    cluster = np.arange(len(seqs)) % 4 - 1
    wide.add_to(sums, cluster)
    assert all((sums[c] == full[cluster == c].sum(axis=0)).all() for c in range(3))
    assert [b - a for a, b in kmers.pieces(["A" * 5, "A" * 5, "A" * 30, "", "A"], 10)] == [2, 1, 2]


@pytest.mark.parametrize("scaled", [False, True])
def test_wide_components_equal_the_eigenvectors(spark, scaled):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 18)) @ rng.normal(size=(18, 18)) + rng.normal(size=18)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "read_idx long, x array<double>").repartition(5)
    a, ra, ea = matrix.principal_components(rows, 8, scaled)
    b, rb, eb = matrix.wide_components(rows, 8, 18, scaled)
    assert ra == pytest.approx(rb, rel=1e-8) and ea.sum() == pytest.approx(eb.sum()) and len(ea) == len(eb)
    own = lambda df: np.array([r.x for r in df.orderBy("read_idx").collect()])
    assert own(a) == pytest.approx(own(b), abs=1e-7)
    few = matrix.wide_components(rows, 2, 18, scaled)  # a panel smaller than the matrix
    assert few[1] == pytest.approx(ra[:2], rel=1e-7) and own(few[0]) == pytest.approx(own(a)[:, :2], abs=1e-3)


def test_wide_components_of_sparse_rows(spark, monkeypatch):
    """Places and values beyond one block of a panel, against the same rows in full."""
    monkeypatch.setattr(matrix, "PANEL", 64)
    rng = np.random.default_rng(12)
    x = np.where(rng.random((200, 150)) < 0.1, rng.normal(size=(200, 150)), 0.0)
    x[:, 3] += np.arange(200) / 20
    x[7] = 0
    sparse = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)]
    rows = spark.createDataFrame(sparse, "read_idx long, i array<int>, v array<double>").repartition(3)
    got, values, every = matrix.principal_components(rows, 3, width=150)
    exact, vectors = np.linalg.eigh(np.cov(x.T))
    assert values == pytest.approx(exact[::-1][:3], rel=1e-6) and every.sum() == pytest.approx(exact.sum())
    own = np.array([r.x for r in got.orderBy("read_idx").collect()])
    assert own[:, 0] == pytest.approx((x - x.mean(axis=0)) @ matrix.signed(vectors[:, ::-1][:, :1])[:, 0], abs=1e-4)


def test_legacy_features_of_long_kmers(spark):
    """k = 6 as places and values holds what the full rows would; k = 8 has 65,612 columns."""
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 150)))) for i in range(60)]
    reads = spark.createDataFrame(rows, "read_idx long, seq string")
    five = {r.read_idx: r.x for r in matrix.legacy_features(reads, 5, True).collect()}
    for r in matrix.legacy_features(reads, 6, True).collect():
        assert dict(zip([j - 4**6 for j in r.i if j >= 4**6], [v for j, v in zip(r.i, r.v) if j >= 4**6])) == {j: v for j, v in enumerate(five[r.read_idx][4**5 :]) if v}
        assert {j: v for j, v in zip(r.i, r.v) if j < 4**6} == pytest.approx({int(j): v for j, v in enumerate(kmers.frequency_matrix([rows[r.read_idx][1]], 6)[0]) if v})
    width = matrix.legacy_width(8, False)
    got, values, every = matrix.principal_components(matrix.legacy_features(reads, 8), 4, width=width)
    assert width == len(every) == 65_548 and len(values) == 4 and got.count() == 60
    model = em.em(reads.withColumn("cluster", F.col("read_idx") % 2), k=8)
    assert model.profiles.shape[1] == 65_536 and em.assignments(reads, model).count() == 60


def test_references_by_cluster(spark):
    """Bitmaps over several buckets, their borders included; unmapped reads and those without a reference are left out."""
    rng = random.Random(14)
    tids = [0, 32_767, 32_768, 65_535, 65_536, 9_999_999, *(rng.randrange(100_000) for _ in range(300))]
    rows = [(f"r{i % 90}", 4 if i % 11 == 0 else 16, t) for i, t in enumerate(tids * 3)] + [("r1", 0, -1)]
    records = spark.createDataFrame(rows, "id string, flag int, tid int")
    clusters = spark.createDataFrame([(f"r{i}", i % 4) for i in range(80)], "id string, cluster int")
    expected = {}
    for i, flag, t in rows:
        if int(i[1:]) < 80 and not flag & 4 and t >= 0:
            expected.setdefault(int(i[1:]) % 4, set()).add(t)
    got = report.references_by_cluster(records, clusters)
    assert {c: own.tolist() for c, own in got.items()} == {c: sorted(own) for c, own in expected.items()}
    assert report.reference_bitmaps(records, clusters).count() < 4 * 7


def plain_alignment(x, y):
    """Score and first best end, from whole tables."""
    low = -(10**6)
    h = [[0 if not i else low for _ in range(len(y) + 1)] for i in range(len(x) + 1)]
    v, g = [[low] * (len(y) + 1) for _ in h], [[low] * (len(y) + 1) for _ in h]
    for i in range(1, len(x) + 1):
        for j in range(len(y) + 1):
            v[i][j] = max(h[i - 1][j] - 6, v[i - 1][j] - 1)
            g[i][j] = max(h[i][j - 1] - 6, g[i][j - 1] - 1) if j else low
            pair = h[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1) if j else low
            h[i][j] = max(pair, v[i][j], g[i][j])
    return max(h[-1]), h[-1].index(max(h[-1]))


def test_alignment_equals_a_plain_table(monkeypatch):
    """Random pairs with insertions and deletions: score and end, and a path that gives that score."""
    rng = random.Random(15)
    rows = []
    for _ in range(120):
        x = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randint(0, len(y)), rng.randint(1, 6)
            y[at : at + n] = [] if rng.random() < 0.5 else [rng.choice("ACGTN") for _ in range(2 * n)]
        pad = lambda: [rng.choice("ACGT") for _ in range(rng.randint(0, 9))]
        rows.append((x, "".join(pad() + y + pad())))
    rows += [("", ""), ("", "ACGT"), ("ACGT", ""), ("ACGTACGTAA", "ACGTACGT"), ("A" * 30, "A" * 30)]
    n, m = (np.array([len(r[i]) for r in rows]) for i in (0, 1))
    for cells in (1, 5_000, 1 << 24):
        monkeypatch.setattr(align, "CELLS", cells)
        seen = []
        for own in align.groups(n, m):
            got = align.aligned(align.codes([rows[i][0] for i in own], int(n[own].max())), n[own], align.codes([rows[i][1] for i in own], int(m[own].max())), m[own])
            for i, (score, begin, end, path) in zip(own.tolist(), got):
                x, y = rows[i]
                assert (score, end) == plain_alignment(x, y)
                a, b, total = 0, begin, 0
                for kind, k in path:
                    if kind == align.PAIR:
                        total += sum(1 if p == q else -1 for p, q in zip(x[a : a + k], y[b : b + k], strict=True))
                    else:
                        total -= 5 + k
                    a, b = a + (k if kind != align.ONLY_2 else 0), b + (k if kind != align.ONLY_1 else 0)
                assert (a, b, total) == (len(x), end, score)
                seen.append(i)
        assert sorted(seen) == list(range(len(rows)))


def test_alignments_of_pairs(spark):
    pairs_ = [("a", "ACGTTGCATTGACC", flipped("TTACGTTGCATTGACCG")), ("b", "ACGTTGCATTGACCATTAGG", flipped("ACGTTGCATTCCCGACCATTAGG")), ("c", None, "ACGT"), ("d", "ACGT", None)]
    got = {r.base_id: tuple(r)[1:] for r in align.alignments(spark.createDataFrame(pairs_, "base_id string, seq1 string, seq2 string")).collect()}
    assert got["a"] == (14, 2, 16, 0, "14M") and got["b"][0] == 20 - 8 and got["b"][3] == 3 and "3D" in got["b"][4]
    assert got["c"] == (0, 0, 0, 0, "") and got["d"] == (-9, 0, 0, 4, "4I")


def plain_path(x, y):
    """Score, begin, end, gaps and path, from whole tables and the order in which equals are taken."""
    low = -(10**6)
    h = [[0 if not i else low for _ in range(len(y) + 1)] for i in range(len(x) + 1)]
    v, g = [[low] * (len(y) + 1) for _ in h], [[low] * (len(y) + 1) for _ in h]
    came, longer_v, longer_g = {}, {}, {}
    for i in range(1, len(x) + 1):
        for j in range(len(y) + 1):
            longer_v[i, j], v[i][j] = v[i - 1][j] - 1 > h[i - 1][j] - 6, max(h[i - 1][j] - 6, v[i - 1][j] - 1)
            if j:
                longer_g[i, j], g[i][j] = g[i][j - 1] - 1 > h[i][j - 1] - 6, max(h[i][j - 1] - 6, g[i][j - 1] - 1)
                h[i][j] = h[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1)
            for kind, score in (("I", v[i][j]), ("D", g[i][j])):
                if score > h[i][j]:
                    h[i][j], came[i, j] = score, kind
    i, j = len(x), h[-1].index(max(h[-1]))
    path, state, end = "", "M", j
    while i:
        state = came.get((i, j), "M") if state == "M" else state
        path += state
        if state == "M":
            i, j = i - 1, j - 1
        elif state == "I":
            state, i = "I" if longer_v[i, j] else "M", i - 1
        else:
            state, j = "D" if longer_g[i, j] else "M", j - 1
    return max(h[-1]), j, end, sum(map(path.count, "ID")), "".join(f"{len(list(own))}{kind}" for kind, own in itertools.groupby(path[::-1]))


def test_paths_equal_those_of_whole_tables(spark):
    """Three and four differences, ties of repeats, gaps, shorter and longer mates, and letters that are no bases."""
    rng = random.Random(17)
    rows = [("", ""), ("", "ACGT"), ("ACGT", ""), ("A", "C"), ("aCGTNNxz", "ACGTNNNN"), ("ACGTé" * 5, "ACGTN" * 5), ("ACGTACGTACGT", "GACGTACTACGTACGT")]
    for _ in range(400):
        letters = rng.choice(["A", "AC", "ACGT", "ACGTN"])
        x = [rng.choice(letters) for _ in range(rng.choice([5, 12, 40]))]
        y = list(x)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(y)) if y else 0
            y[at : at + 1] = [rng.choice("ACGT")]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at, k = rng.randint(0, len(y)), rng.randint(1, 4)
            y[at : at + (k if rng.random() < 0.5 else 0)] = [rng.choice(letters) for _ in range(rng.choice([0, k]))]
        pad = lambda: [rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 3]))]
        rows.append(("".join(x), "".join(pad() + y + pad())))
    pairs_ = [(str(i), x, flipped(y)) for i, (x, y) in enumerate(rows)]
    got = {int(r.base_id): tuple(r)[1:] for r in align.alignments(spark.createDataFrame(pairs_, "base_id string, seq1 string, seq2 string")).collect()}
    assert len(got) == len(rows)
    for i, (x, y) in enumerate(rows):
        assert got[i] == plain_path(x.replace("é", "?"), y), (x, y)


def test_alike_mates_need_no_tables():
    """CPU seconds grow with the letters of mates that differ in few places, not with the cells of their tables."""
    rng = np.random.default_rng(18)
    x = rng.integers(65, 69, (8_000, 150)).astype(np.uint8)
    y = x.copy()
    y[np.arange(8_000), rng.integers(0, 150, 8_000)] = 78
    y[:, -1] = 78
    n = np.full(8_000, 150)
    began = time.process_time()
    got = [found for own in align.groups(n, n) for found in align.aligned(x[own], n[own], y[own], n[own])]
    assert {(*found[1:3], str(found[3])) for found in got} == {(0, 150, "[(0, 150)]")} and {found[0] for found in got} == {146, 148}
    assert time.process_time() - began < 3


def test_one_layout_by_base_id(spark, tmp_path):
    """Reads in buckets of base ids: no shuffle below the mate join, the summary's rows alone are shuffled for support."""
    rng = random.Random(16)
    rows = [(f"r{i}/{m}", "".join(rng.choice("ACGT") for _ in range(40))) for i in range(60) for m in (1, 2) if rng.random() < 0.9]
    reads = spark.createDataFrame(rows, "id string, seq string")
    laid = pairs.by_base_id(reads, "laid_reads", str(tmp_path / "laid"), 4)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(pairs.mate_join(laid)) and "Exchange" in plan(pairs.mate_join(reads))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert plan(pairs.support_of_reads(laid)).count("Exchange hashpartitioning") == 1 < plan(pairs.support_of_reads(reads)).count("Exchange hashpartitioning")
        for f in (pairs.support_of_reads, pairs.with_evidence, pairs.mate_join):
            a, b = f(laid), f(reads)
            shared = [c for c in b.columns if c in a.columns]
            assert sorted(map(str, a.select(shared).collect())) == sorted(map(str, b.select(shared).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE laid_reads")
