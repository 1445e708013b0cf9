"""Queries: quality control and sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import damage as dmf
from seqloom.functions import sequence as sq
from seqloom.operators import kmers, qc
from seqloom.plans import reads as rd
from seqloom.plans.registry import GC, query

def base():
    return F.col("seq")


def six(c):
    return F.round(c, 6) + F.lit(0.0)


@query("SELECT count(*) AS total, count(*) FILTER (length(seq) < 30) AS short, count(*) FILTER (length(seq) >= 30) AS passed FROM all_reads")
def qc_counters(spark, sf):
    return qc.counters(rd.all_reads(spark, sf))


@query("SELECT read_idx, length(seq)::INTEGER AS length FROM reads")
def min_length_filter(spark, sf):
    return qc.long_enough(rd.all_reads(spark, sf)).select("read_idx", F.length("seq").alias("length"))


@query("SELECT read_idx, id FROM all_reads WHERE id IN (SELECT id FROM all_reads WHERE seq LIKE '%G%' OR seq LIKE '%C%') AND id IN (SELECT id FROM all_reads WHERE length(seq) >= 15)")
def consistency_semijoin(spark, sf):
    every = rd.all_reads(spark, sf)
    gc = every.select("id", sq.gc_content(base()).alias("gc")).where("gc > 0")
    return qc.consistent(every, gc, every.where(F.length("seq") >= 15)).select("read_idx", "id")


@query(f"""SELECT count(*) AS reads, count(*) FILTER (g AND d) AS kept, count(*) FILTER (NOT g) AS missing_gc, count(*) FILTER (NOT d) AS missing_damage
  FROM (SELECT {GC} > 0 AS g, length(seq) >= 15 AS d FROM all_reads)""")
def consistency_counters(spark, sf):
    every = rd.all_reads(spark, sf)
    return qc.consistency_report(every, gc=every.where(sq.gc_content(base()) > 0), damage=every.where(F.length("seq") >= 15))[0]


@query(f", side AS (SELECT id, {GC} AS gc FROM reads) SELECT read_idx, round(coalesce(gc, 0.5::DOUBLE), 6) AS gc FROM all_reads LEFT JOIN side USING (id)")
def side_table_default(spark, sf):
    side = rd.reads(spark, sf).select("id", sq.gc_content(base()).alias("gc"))
    return qc.with_side(rd.all_reads(spark, sf), side, {"gc": 0.5}).select("read_idx", six(F.col("gc")).alias("gc"))


@query(f"SELECT read_idx, round({GC}, 6) + 0.0::DOUBLE AS gc FROM all_reads")
def gc_content(spark, sf):
    return rd.all_reads(spark, sf).select("read_idx", six(sq.gc_content(base())).alias("gc"))


@query(f"""SELECT source, floor({GC} * 10)::INTEGER AS gc_bin, count(*) AS n, round(avg(length(seq)), 6) AS avg_length, min({GC}) < 0.3::DOUBLE AS low
  FROM reads GROUP BY ALL""")
def gc_by_source(spark, sf):
    rows = rd.reads(spark, sf).select("source", sq.gc_content(base()).alias("gc"), F.length("seq").alias("length"))
    return rows.groupBy("source", F.floor(F.col("gc") * 10).cast("int").alias("gc_bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 6).alias("avg_length"), (F.min("gc") < 0.3).alias("low"))


@query(""", l AS (SELECT unnest(range(4)) AS i, unnest(['A','C','G','T']) AS l), every AS (SELECT (((a.i * 4 + b.i) * 4 + c.i) * 4 + d.i)::INTEGER AS kmer_idx, a.l || b.l || c.l || d.l AS kmer FROM l a, l b, l c, l d),
  w AS (SELECT read_idx, upper(substr(seq, unnest(range(1, length(seq) - 2)), 4)) AS kmer FROM reads)
  SELECT kmer_idx, kmer, count(DISTINCT read_idx) AS reads FROM every LEFT JOIN w USING (kmer) GROUP BY kmer_idx, kmer""")
def kmer_enumerate(spark, sf):
    """Every 4-mer, and the number of reads that have it."""
    found = kmers.kmer_counts(rd.reads(spark, sf), 4).groupBy("kmer_idx").agg(F.count(F.lit(1)).alias("reads"))
    return kmers.enumerate_kmers(spark, 4).join(found, "kmer_idx", "left").select("kmer_idx", "kmer", F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))


def _freq_sql(k: int) -> str:
    return f""", w AS (SELECT read_idx, source, length(seq) - {k - 1} AS n, substr(seq, unnest(range(1, length(seq) - {k - 2})), {k}) AS kmer FROM reads),
  f AS (SELECT read_idx, source, kmer, count(*) / n AS freq FROM w WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY read_idx, source, n, kmer)
  SELECT source, kmer, count(*) AS reads, round(sum(freq), 6) AS freq FROM f GROUP BY source, kmer"""


def _freq(spark, sf, k):
    by_read = kmers.kmer_frequencies(rd.reads(spark, sf), k, ["source"])
    return by_read.groupBy("source", "kmer").agg(F.count(F.lit(1)).alias("reads"), six(F.sum("freq")).alias("freq"))


@query(_freq_sql(2))
def kmer_freq_k2(spark, sf):
    return _freq(spark, sf, 2)


@query(_freq_sql(4))
def kmer_freq_k4(spark, sf):
    return _freq(spark, sf, 4)


@query(""", w AS (SELECT read_idx, upper(substr(seq, unnest(range(1, length(seq) - 2)), 4)) AS kmer FROM reads),
  c AS (SELECT read_idx, kmer, least(count(*), 65535) AS n FROM w WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY read_idx, kmer)
  SELECT (64 * (strpos('ACGT', kmer[1]) - 1) + 16 * (strpos('ACGT', kmer[2]) - 1) + 4 * (strpos('ACGT', kmer[3]) - 1) + strpos('ACGT', kmer[4]) - 1)::INTEGER AS kmer_idx,
         count(*) AS reads, sum(n)::BIGINT AS n, max(n)::INTEGER AS most FROM c GROUP BY kmer""")
def kmer_index_counts(spark, sf):
    return kmers.kmer_counts(rd.reads(spark, sf), 4).groupBy("kmer_idx").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query(""", w AS (SELECT read_idx, source, length(seq) // 3 AS n, substr(seq, 3 * unnest(range(0, length(seq) // 3)) + 1, 3) AS codon FROM reads),
  f AS (SELECT read_idx, source, codon, count(*) / n AS freq FROM w GROUP BY read_idx, source, n, codon)
  SELECT source, codon, count(*) AS reads, round(sum(freq), 6) AS freq FROM f GROUP BY source, codon""")
def codon_usage(spark, sf):
    by_read = kmers.codon_usage(rd.reads(spark, sf), ["source"])
    return by_read.groupBy("source", "codon").agg(F.count(F.lit(1)).alias("reads"), six(F.sum("freq")).alias("freq"))


@query("SELECT read_idx, round(log2(length(seq)) / 12, 6) + 0.0::DOUBLE AS norm_length FROM all_reads")
def norm_length(spark, sf):
    return rd.all_reads(spark, sf).select("read_idx", six(sq.norm_length(base())).alias("norm_length"))


@query("SELECT read_idx, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM all_reads")
def reverse_complement(spark, sf):
    return rd.all_reads(spark, sf).select("read_idx", sq.reverse_complement(base()).alias("rc"))


@query(""", s AS (SELECT read_idx, seq, least(15, length(seq) // 4, length(seq) // 2) AS n FROM all_reads)
  SELECT read_idx, n::INTEGER AS n, length(regexp_replace(substr(seq, 1, n), '[^TC]', '', 'g'))::INTEGER AS tc,
         length(regexp_replace(substr(seq, length(seq) - n + 1, n), '[^AG]', '', 'g'))::INTEGER AS ag FROM s""")
def terminal_counts(spark, sf):
    n = dmf.segment_length(base())
    return rd.all_reads(spark, sf).select("read_idx", n.alias("n"), sq.count_of(dmf.five(base(), n), "TtCc").alias("tc"), sq.count_of(dmf.three(base(), n), "AaGg").alias("ag"))


@query(""", v AS (SELECT unnest(['/1', '/2', '.1', '_2', '-1', ':2', '#1', '.pair.2', '_R1_001', '_R2_001', '_1_x', '_2_x', '_1_10_y', '']) AS suffix),
  i AS (SELECT id || suffix AS id, suffix FROM reads, v)
  SELECT id, CASE suffix WHEN '_R1_001' THEN replace(id, '_R1_', '_') WHEN '_R2_001' THEN replace(id, '_R2_', '_') WHEN '_1_x' THEN CASE WHEN contains(id, '_10_') OR contains(id, '_11_') THEN id ELSE replace(id, '_1_', '_') END
    WHEN '_2_x' THEN CASE WHEN contains(id, '_1_') AND NOT contains(id, '_10_') AND NOT contains(id, '_11_') THEN replace(id, '_1_', '_') WHEN contains(id, '_20_') OR contains(id, '_21_') THEN id ELSE replace(id, '_2_', '_') END
    WHEN '_1_10_y' THEN CASE WHEN contains(id, '_2_') AND NOT contains(id, '_20_') AND NOT contains(id, '_21_') THEN replace(id, '_2_', '_') ELSE id END
    WHEN '.pair.2' THEN replace(id, '.2', '')
    WHEN '' THEN CASE WHEN ends_with(id, '_1') THEN replace(id, '_1', '') WHEN ends_with(id, '_2') THEN replace(id, '_2', '') ELSE id END ELSE replace(id, suffix, '') END AS base_id,
  CASE WHEN suffix IN ('/1', '.1', '-1', '#1', '_R1_001') THEN 1 WHEN suffix IN ('/2', '_2', ':2', '.pair.2', '_R2_001') THEN 2
    WHEN suffix = '_1_x' THEN CASE WHEN contains(id, '_10_') OR contains(id, '_11_') THEN 0 ELSE 1 END
    WHEN suffix = '_2_x' THEN CASE WHEN contains(id, '_1_') AND NOT contains(id, '_10_') AND NOT contains(id, '_11_') THEN 1 WHEN contains(id, '_20_') OR contains(id, '_21_') THEN 0 ELSE 2 END
    WHEN suffix = '_1_10_y' THEN CASE WHEN contains(id, '_2_') AND NOT contains(id, '_20_') AND NOT contains(id, '_21_') THEN 2 ELSE 0 END
    WHEN ends_with(id, '_1') THEN 1 WHEN ends_with(id, '_2') THEN 2 ELSE 0 END::INTEGER AS mate FROM i""")
def read_id_parse(spark, sf):
    suffixes = ["/1", "/2", ".1", "_2", "-1", ":2", "#1", ".pair.2", "_R1_001", "_R2_001", "_1_x", "_2_x", "_1_10_y", ""]
    ids = rd.reads(spark, sf).select("id", F.explode(F.array(*map(F.lit, suffixes))).alias("suffix")).select(F.concat("id", "suffix").alias("id"))
    return ids.select("id", sq.base_id(F.col("id")).alias("base_id"), sq.mate(F.col("id")).alias("mate"))


@query(""", q AS (SELECT read_idx, (unnest(range(0, length(seq))) * 7 + doc_id) % 41 AS s FROM reads)
  SELECT read_idx, count(*)::INTEGER AS n, sum(s)::BIGINT AS total, max(s)::INTEGER AS most FROM q GROUP BY read_idx""")
def phred_decode(spark, sf):
    scores = rd.reads(spark, sf).withColumn("quality", rd.quality_string()).select("read_idx", sq.phred(F.col("quality")).alias("q"))
    return scores.select("read_idx", F.size("q").alias("n"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("q").cast("int").alias("most"))


@query("""SELECT base, count(*) AS n, bool_and(base IN ('A', 'C', 'G', 'T')) AS standard, max(CASE WHEN base IN ('C', 'G', 'T') THEN strpos('ACGT', base) - 1 ELSE 0 END)::INTEGER AS base_index
  FROM (SELECT unnest(string_split(seq, '')) AS base FROM reads) GROUP BY base""")
def base_composition(spark, sf):
    bases = rd.reads(spark, sf).select(F.explode(F.split("seq", "")).alias("base"))
    return bases.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.every(sq.is_standard(F.col("base"))).alias("standard"), F.max(sq.base_index(F.col("base"))).alias("base_index"))
