"""Queries: profiles and EM steps from a fixed start (clusters by GC share), and the whole loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.sequence import gc_content
from seqloom.operators import em as em_op
from seqloom.operators import matrix
from seqloom.operators import profiles as pf
from seqloom.plans import reads as rd
from seqloom.plans.queries.sequence import six
from seqloom.plans.registry import query
from seqloom.storage import checkpoint


def binned(spark, sf):
    return rd.reads(spark, sf).withColumn("gc", gc_content(F.col("seq"))).withColumn("cluster", rd.bin_of(F.col("gc"))).withColumn("start", F.col("cluster"))


COUNTS = """, w AS (SELECT read_idx, upper(substr(seq, unnest(range(1, length(seq) - 2)), 4)) AS kmer FROM reads),
  counts AS (SELECT read_idx, (64 * (strpos('ACGT', kmer[1]) - 1) + 16 * (strpos('ACGT', kmer[2]) - 1) + 4 * (strpos('ACGT', kmer[3]) - 1) + strpos('ACGT', kmer[4]) - 1)::INTEGER AS kmer_idx, least(count(*), 65535) AS n
    FROM w WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY read_idx, kmer)"""


def _profiles(name: str, assigned: str) -> str:
    """profiles from an assignment table (read_idx, cluster)."""
    return f""", {name}_dom AS (SELECT cluster, unnest(range(256))::INTEGER AS kmer_idx FROM (SELECT DISTINCT cluster FROM {assigned} WHERE cluster >= 0)),
  {name}_sums AS (SELECT cluster, kmer_idx, sum(n) AS n FROM counts JOIN {assigned} USING (read_idx) WHERE cluster >= 0 GROUP BY cluster, kmer_idx),
  {name} AS (SELECT cluster, kmer_idx, (coalesce(n, 0) + 0.5::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY cluster) + 128.0::DOUBLE) AS p
    FROM {name}_dom LEFT JOIN {name}_sums USING (cluster, kmer_idx))"""


START = f"{COUNTS}{_profiles('profiles', 'binned')}"
ESTEP = f"""{START}, ll AS (SELECT read_idx, cluster, sum(n * ln(p)) AS ll FROM counts JOIN profiles USING (kmer_idx) GROUP BY read_idx, cluster),
  estep AS (SELECT read_idx, cluster, ll FROM (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY round(ll, 6) DESC, cluster) AS r FROM ll) WHERE r = 1)"""
JSD = f"""{START}, jsd AS (SELECT a.cluster AS a, b.cluster AS b, greatest(0.0::DOUBLE, 0.5::DOUBLE * sum(a.p * ln(a.p / ((a.p + b.p) / 2))) + 0.5::DOUBLE * sum(b.p * ln(b.p / ((a.p + b.p) / 2)))) AS jsd
  FROM profiles a JOIN profiles b ON a.kmer_idx = b.kmer_idx AND a.cluster < b.cluster GROUP BY a.cluster, b.cluster)"""
TOTAL = f"{START}, total AS (SELECT sum(n * ln(p)) AS ll FROM counts JOIN binned USING (read_idx) JOIN profiles USING (cluster, kmer_idx))"


def _start(spark, sf):
    """The reads with their clusters, the clusters' sums, and their profiles (small tables, written once)."""
    reads = binned(spark, sf)
    sums = checkpoint(pf.kmer_sums(reads))
    return reads, sums, checkpoint(pf.build_profiles(sums))


def _estep(spark, sf, kept):
    reads, _, profiles = _start(spark, sf)
    return pf.best_clusters(reads, pf.log_matrix(profiles), 4, kept)


@query("SELECT cluster AS old, count(*) AS size, (row_number() OVER (ORDER BY cluster) - 1)::INTEGER AS cluster FROM binned WHERE cluster >= 0 GROUP BY binned.cluster HAVING count(*) >= 3", "binned")
def em_init_filter(spark, sf):
    return pf.initial_clusters(binned(spark, sf))


@query(f"{START} SELECT cluster, kmer_idx, round(p, 6) AS p, round(ln(p), 6) AS log_p FROM profiles", "binned")
def profile_build(spark, sf):
    return _start(spark, sf)[2].select("cluster", "kmer_idx", six("p").alias("p"), six("log_p").alias("log_p"))


@query(f"{ESTEP} SELECT read_idx, cluster, round(ll, 4) AS ll FROM estep", "binned")
def em_estep(spark, sf):
    return _estep(spark, sf, ["read_idx"]).withColumn("ll", F.round("ll", 4))


@query(f"{ESTEP}{_profiles('next', 'estep')} SELECT cluster, kmer_idx, round(p, 6) AS p FROM next", "binned")
def em_mstep(spark, sf):
    assigned = _estep(spark, sf, ["seq"])
    sums = checkpoint(pf.kmer_sums(assigned))
    return pf.build_profiles(sums).select("cluster", "kmer_idx", six("p").alias("p"))


@query(f"{TOTAL} SELECT round(ll, 3) AS ll FROM total", "binned")
def total_loglik(spark, sf):
    _, sums, profiles = _start(spark, sf)
    return pf.total_likelihood(sums, profiles).select(F.round("ll", 3).alias("ll"))


@query(f"{JSD} SELECT a, b, round(jsd, 6) AS jsd FROM jsd", "binned")
def jsd_pairs(spark, sf):
    return pf.divergences(_start(spark, sf)[2]).withColumn("jsd", six("jsd"))


@query(f"{JSD} SELECT a, b, round(jsd, 6) AS jsd FROM jsd ORDER BY jsd.jsd, a, b LIMIT 1", "binned")
def most_similar_pair(spark, sf):
    return pf.most_similar(pf.divergences(_start(spark, sf)[2])).withColumn("jsd", six("jsd"))


@query(f"""{TOTAL}, shape AS (SELECT count(DISTINCT cluster) AS c, count(*) AS n FROM binned WHERE cluster >= 0)
  SELECT c AS clusters, n AS reads, round(-2 * ll + (c * 255 + c - 1) * ln(n::DOUBLE), 3) AS bic FROM total, shape""", "binned")
def bic(spark, sf):
    reads, sums, profiles = _start(spark, sf)
    shape = reads.where("cluster >= 0").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("reads"))
    both = pf.total_likelihood(sums, profiles).join(F.broadcast(shape))  # one row each
    return both.select("clusters", "reads", F.round(pf.bic(F.col("ll"), F.col("clusters"), F.col("reads")), 3).alias("bic"))


@query(f"""{JSD}, pair AS (SELECT a, b FROM jsd ORDER BY jsd.jsd, a, b LIMIT 1)
  SELECT read_idx, (CASE WHEN cluster = b THEN a WHEN cluster > b THEN cluster - 1 ELSE cluster END)::INTEGER AS cluster FROM binned, pair""", "binned")
def merge_relabel(spark, sf):
    pair = pf.most_similar(pf.divergences(_start(spark, sf)[2])).select("a", "b")
    return pf.relabelled(binned(spark, sf).join(F.broadcast(pair)), F.col("a"), F.col("b")).select("read_idx", "cluster")


@query(f"{ESTEP} SELECT count(*) FILTER (binned.cluster <> estep.cluster) AS changes, count(*) AS reads FROM binned JOIN estep USING (read_idx)", "binned")
def assignment_changes(spark, sf):
    moved = _estep(spark, sf, ["start"])
    return moved.agg(F.count_if(F.col("start") != F.col("cluster")).alias("changes"), F.count(F.lit(1)).alias("reads"))


@query("SELECT old, (row_number() OVER (ORDER BY old) - 1)::INTEGER AS cluster FROM (SELECT DISTINCT cluster AS old FROM binned WHERE cluster >= 0)", "binned")
def renumber_clusters(spark, sf):
    return pf.renumbered(binned(spark, sf).where("cluster >= 0").select(F.col("cluster").alias("old")).distinct(), "old")


@query()
def em_full(spark, sf):
    reads = checkpoint(rd.reads(spark, sf).select("read_idx", "seq"))  # some thirty passes read it
    pcs, _, _ = matrix.principal_components(checkpoint(matrix.features18(reads)), 8, scaled=True)
    start = reads.join(matrix.k_means(pcs, 15), "read_idx")
    return em_op.assignments(reads, em_op.em(start))


@query()
def contig_mapping(spark, sf):
    """Long reads stand for contigs: they are clustered, and all reads are mapped to the final profiles."""
    contigs = binned(spark, sf).where(F.length("seq") >= 120)
    return em_op.map_reads(rd.reads(spark, sf), em_op.em(contigs))


def _rounds_sql(rounds: int, units: str) -> str:
    """Assignments a1, a2 ... and profiles p0, p1 ... of rounds without merging, from the bins of the units (a condition)."""
    parts = [f"""{COUNTS}, units AS MATERIALIZED (SELECT read_idx, cluster FROM binned WHERE {units}),
  large AS (SELECT cluster FROM units WHERE cluster >= 0 GROUP BY cluster HAVING count(*) >= 3), a0 AS (SELECT read_idx, cluster FROM units SEMI JOIN large USING (cluster)){_profiles('p0', 'a0')}"""]
    for i in range(1, rounds + 1):
        parts.append(f", {_best(f'a{i}', f'p{i - 1}', 'units')}{_profiles(f'p{i}', f'a{i}')}")
    return "".join(parts)


def _best(name: str, profiles: str, units: str) -> str:
    """The best cluster of each unit; one without k-mers goes to the first."""
    return f"""{name}_ll AS (SELECT read_idx, cluster, sum(n * ln(p)) AS ll FROM counts SEMI JOIN {units} USING (read_idx) JOIN {profiles} USING (kmer_idx) GROUP BY read_idx, cluster),
  {name}_top AS (SELECT read_idx, cluster FROM (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY round(ll, 6) DESC, cluster) AS r FROM {name}_ll) WHERE r = 1),
  {name} AS MATERIALIZED (SELECT units.read_idx, coalesce(t.cluster, (SELECT min(cluster) FROM {profiles})) AS cluster FROM {units} units LEFT JOIN {name}_top t USING (read_idx))"""


@query(f"{_rounds_sql(3, 'true')} SELECT read_idx, (dense_rank() OVER (ORDER BY cluster) - 1)::INTEGER AS cluster FROM a3", "binned")
def em_rounds(spark, sf):
    """Three rounds from the bins, without merging."""
    reads = binned(spark, sf).select("read_idx", "seq", "cluster")
    return em_op.assignments(reads, em_op.em(reads, max_rounds=3, merge=False))


@query(f"""{_rounds_sql(2, 'length(seq) >= 120')}, {_best('mapped', 'p2', 'reads')}, names AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS nr FROM (SELECT DISTINCT cluster FROM p2))
  SELECT read_idx, nr::INTEGER AS cluster FROM mapped JOIN names USING (cluster)""", "binned")
def contig_rounds(spark, sf):
    """Long reads stand for contigs: two rounds from their bins, and all reads mapped to the profiles that these leave."""
    contigs = binned(spark, sf).where(F.length("seq") >= 120).select("seq", "cluster")
    return em_op.map_reads(rd.reads(spark, sf), em_op.em(contigs, max_rounds=2, merge=False))
