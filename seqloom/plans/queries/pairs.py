"""Queries: mate pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import align, pairs
from seqloom.plans import reads as rd
from seqloom.plans.queries.sequence import six
from seqloom.plans.registry import query

# The reads' own ids end in _<number>; the mate token comes after it, so the base id is the read's id.
PAIRED = """, paired AS (SELECT a.id[:-3] AS base_id, a.seq AS seq1, b.seq AS seq2, reverse(translate(b.seq, 'ACGT', 'TGCA')) AS rc2
  FROM mates a JOIN mates b ON a.id[:-3] = b.id[:-3] WHERE ends_with(a.id, '/1') AND ends_with(b.id, '/2'))"""
MISMATCHES = f"""{PAIRED}, bases AS (SELECT base_id, length(seq1) AS len, pos, seq1[pos + 1] AS base1, rc2[pos + 1] AS base2, least(10, length(seq1) // 5) AS t
  FROM (SELECT *, unnest(range(0, length(seq1))) AS pos FROM paired WHERE length(seq1) >= 10 AND length(seq1) <= length(rc2))),
  mm AS (SELECT *, CASE WHEN pos < t AND base1 = 'T' AND base2 = 'C' THEN 'CT5' WHEN pos >= len - t AND base1 = 'A' AND base2 = 'G' THEN 'GA3'
    WHEN pos >= len - t AND base1 = 'G' AND base2 = 'A' THEN 'CT3' WHEN pos < t AND base1 = 'C' AND base2 = 'T' THEN 'GA5' ELSE 'Other' END AS pattern FROM bases WHERE base1 <> base2 AND base1 IN ('A', 'C', 'G', 'T') AND base2 IN ('A', 'C', 'G', 'T'))"""
SUMMARY = f"""{MISMATCHES}, d AS (SELECT *, CASE WHEN pattern IN ('CT5', 'GA5') THEN pos WHEN pattern IN ('GA3', 'CT3') THEN len - pos END AS dist FROM mm),
  s AS (SELECT base_id, count(*) FILTER (pattern IN ('CT5', 'GA5')) AS c_to_t, count(*) FILTER (pattern IN ('GA3', 'CT3')) AS g_to_a, count(*) FILTER (pattern = 'Other') AS other,
    count(*) FILTER (pattern IN ('CT5', 'GA3')) AS main, avg(CASE WHEN dist IS NOT NULL THEN least(10.0::DOUBLE / (dist + 1), 1.0::DOUBLE) END) AS near FROM d GROUP BY base_id),
  summary AS (SELECT base_id, length(seq1)::INTEGER AS overlap_size, length(seq1) >= 10 AS has_overlap, coalesce(c_to_t, 0) AS c_to_t, coalesce(g_to_a, 0) AS g_to_a, coalesce(other, 0) AS other,
    CASE WHEN coalesce(main, 0) + coalesce(other, 0) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, 0.7::DOUBLE * main / (main + other) + 0.3::DOUBLE * coalesce(near, 0.5::DOUBLE)) END AS support
    FROM paired LEFT JOIN s USING (base_id))"""


@query(f"{PAIRED} SELECT base_id, seq1, seq2 FROM paired", "mates")
def mate_join(spark, sf):
    return pairs.mate_join(rd.mates(spark, sf))


@query(f"{MISMATCHES} SELECT base_id, pos::INTEGER AS pos, base1, base2, pattern FROM mm", "mates")
def mate_mismatches(spark, sf):
    return pairs.mismatches(pairs.mate_join(rd.mates(spark, sf))).select("base_id", "pos", "base1", "base2", "pattern")


@query(f"{SUMMARY} SELECT base_id, overlap_size, has_overlap, c_to_t, g_to_a, other, round(support, 6) AS support FROM summary", "mates")
def mate_overlap_summary(spark, sf):
    return pairs.pair_summary(pairs.mate_join(rd.mates(spark, sf))).withColumn("support", six("support"))


@query(f"""{SUMMARY}, lone AS (SELECT id FROM mates UNION ALL SELECT concat(id, '/1') FROM all_reads WHERE length(seq) < 30)
  SELECT id, round(coalesce(support, 0.5::DOUBLE), 6) AS support FROM lone LEFT JOIN summary ON base_id = id[:-3]""", "mates")
def mate_support_default(spark, sf):
    short = rd.all_reads(spark, sf).where(F.length("seq") < 30).select(F.concat("id", F.lit("/1")).alias("id"), "seq")
    return pairs.support_of_reads(rd.mates(spark, sf).unionByName(short)).withColumn("support", six("support"))


# Short reads lack mate 2; those of some documents have mate 2 alone, mate 1 twice, or no mate's name.
LONE = """lone AS (SELECT CASE doc_id % 5 WHEN 0 THEN concat(id, '/2') WHEN 1 THEN concat(id, 'x') ELSE concat(id, '/1') END AS id, doc_id FROM all_reads WHERE length(seq) < 30)"""


@query(f""", {LONE}, cached AS (SELECT id FROM mates UNION ALL SELECT id FROM lone UNION ALL SELECT id FROM lone WHERE doc_id % 5 = 2),
  named AS (SELECT id[:-3] AS base_id, right(id, 1)::INTEGER AS mate FROM cached WHERE right(id, 2) IN ('/1', '/2')),
  sides AS (SELECT base_id, count(*) AS n, min(mate) AS first, count(*) FILTER (mate = 2) AS n2, count(DISTINCT mate) AS mates FROM named GROUP BY base_id)
  SELECT (SELECT count(*) FROM cached) AS lookups, coalesce(sum(n) FILTER (mates = 2), 0)::BIGINT AS hits, (SELECT count(*) FROM named) AS inserts,
    sum(CASE WHEN first = 1 THEN n2 ELSE 0 END)::BIGINT AS pair_found, sum(CASE WHEN first = 1 THEN n - n2 ELSE n2 END)::BIGINT AS pair_not_found,
    (SELECT count(*) FROM cached WHERE right(id, 1) = 'x') AS unnamed, count(*) FILTER (mates = 2) AS alignments FROM sides""", "mates")
def pair_counters(spark, sf):
    kind = F.col("doc_id") % 5
    name = F.concat("id", F.when(kind == 0, "/2").when(kind == 1, "x").otherwise("/1"))
    short = rd.all_reads(spark, sf).where(F.length("seq") < 30).select(name.alias("id"), "seq", kind.alias("kind"))
    return pairs.pair_counters(rd.mates(spark, sf).unionByName(short.drop("kind")).unionByName(short.where("kind = 2").drop("kind")))


# The mates differ by replaced bases only, at most three: no path with gaps is better.
@query(f"""{PAIRED}, letters AS (SELECT base_id, length(seq1) AS len, CASE WHEN seq1[pos + 1] = rc2[pos + 1] THEN 1 ELSE -1 END AS s FROM (SELECT *, unnest(range(0, length(seq1))) AS pos FROM paired))
  SELECT base_id, sum(s)::INTEGER AS score, 0 AS begin, len::INTEGER AS "end", 0 AS gaps, concat(len, 'M') AS path FROM letters GROUP BY base_id, len""", "mates")
def mate_alignment(spark, sf):
    return align.alignments(pairs.mate_join(rd.mates(spark, sf)))
