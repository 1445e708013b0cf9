"""Queries: statistics, labels, reports and dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.sequence import gc_content
from seqloom.operators import damage as dm
from seqloom.operators import report as rp
from seqloom.plans import reads as rd
from seqloom.plans.queries.damage import FAST
from seqloom.plans.queries.sequence import six
from seqloom.plans.registry import GC, query

ROWS = f"""{FAST}, rows AS (SELECT binned.read_idx, id, source, cluster, gc, d5 AS damage5, d3 AS damage3, combined FROM binned JOIN fast USING (read_idx))"""
STATS = f"""{ROWS}, stats AS (SELECT cluster, count(*) AS num_reads, avg(gc) AS avg_gc, avg(combined) AS avg_damage, avg(damage5) AS avg_damage5, avg(damage3) AS avg_damage3 FROM rows GROUP BY cluster)"""
LABEL = """CASE WHEN cluster = -1 THEN 'Noise' ELSE concat('Bin ', cluster::VARCHAR, ' [', CASE WHEN avg_gc < 0.3::DOUBLE THEN 'very-low-GC' WHEN avg_gc < 0.4::DOUBLE THEN 'low-GC' WHEN avg_gc < 0.5::DOUBLE THEN 'mid-GC' WHEN avg_gc < 0.6::DOUBLE THEN 'high-GC' ELSE 'very-high-GC' END,
  ', ', CASE WHEN avg_damage >= 0.5::DOUBLE THEN 'ancient' ELSE 'modern/ambiguous' END, ']') END"""


def rows(spark, sf):
    return dm.fast_damage(rd.reads(spark, sf)).withColumn("gc", gc_content(F.col("seq"))).withColumn("cluster", rd.bin_of(F.col("gc")))


def stats(spark, sf):
    return rp.cluster_stats(rows(spark, sf))


def labelled(spark, sf):
    return stats(spark, sf).withColumn("taxonomy", rp.taxonomy(F.col("cluster"), F.col("avg_gc"), F.col("avg_damage")))


AVERAGES = ("avg_gc", "avg_damage", "avg_damage5", "avg_damage3")


@query(f"{STATS} SELECT cluster, num_reads, {', '.join(f'round({c}, 6) AS {c}' for c in AVERAGES)} FROM stats", "binned")
def cluster_stats(spark, sf):
    return stats(spark, sf).select("cluster", "num_reads", *[six(c).alias(c) for c in AVERAGES])


@query(f"{STATS} SELECT cluster, {LABEL} AS taxonomy, CASE WHEN cluster = -1 THEN 'Noise' ELSE concat('Cluster ', cluster::VARCHAR) END AS shown FROM stats", "binned")
def taxonomy_label(spark, sf):
    return labelled(spark, sf).select("cluster", "taxonomy", rp.dashboard_label(F.col("cluster")).alias("shown"))


@query(f"""{STATS} SELECT cluster::VARCHAR AS "{rp.REPORT[0]}", num_reads::VARCHAR AS "{rp.REPORT[1]}", {', '.join(f'format(chr(123) || chr(58) || chr(46) || $$4f$$ || chr(125), {c}) AS "{n}"' for c, n in zip(AVERAGES, rp.REPORT[2:6]))}, {LABEL} AS "{rp.REPORT[6]}" FROM stats""", "binned")
def report_csv_rows(spark, sf):
    return rp.report_rows(labelled(spark, sf))


@query(f"""{ROWS} SELECT count(*) AS reads, count(DISTINCT cluster) FILTER (cluster <> -1) AS clusters, round(100.0::DOUBLE * count(*) FILTER (cluster = -1) / count(*), 6) AS noise_percent, round(avg(combined), 6) AS mean_damage FROM rows""", "binned")
def global_summary(spark, sf):
    return rp.global_summary(rows(spark, sf)).withColumn("noise_percent", six("noise_percent")).withColumn("mean_damage", six("mean_damage"))


@query(f"{STATS} SELECT cluster, num_reads, round(100.0::DOUBLE * num_reads / max(num_reads) OVER (), 6) AS percent_of_max FROM stats WHERE cluster <> -1 ORDER BY num_reads DESC, cluster LIMIT 10", "binned")
def top10_clusters(spark, sf):
    return rp.top_clusters(stats(spark, sf)).select("cluster", "num_reads", six("percent_of_max").alias("percent_of_max"))


@query("SELECT read_idx, cluster FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM binned) WHERE n >= 5 OR cluster = -1", "binned")
def min_size_filter(spark, sf):
    return rp.min_size_filter(rows(spark, sf)).select("read_idx", "cluster")


@query(f"""{ROWS}, v AS (SELECT 5 AS "end", damage5 AS v FROM rows UNION ALL SELECT 3, damage3 FROM rows)
  SELECT "end"::INTEGER AS "end", greatest(0, least(29, floor(v * 30)))::INTEGER AS bin, count(*) AS n FROM v GROUP BY ALL""", "binned")
def damage_histogram(spark, sf):
    return rp.damage_histogram(rows(spark, sf))


@query(f"""{STATS} SELECT cluster, num_reads, round(greatest(10.0::DOUBLE, log10(num_reads) * 15), 6) AS log_size, round(greatest(5.0::DOUBLE, sqrt(num_reads / 100.0::DOUBLE) * 20), 6) AS root_size,
  (40 - 2 * (row_number() OVER (ORDER BY num_reads DESC, cluster) - 1))::INTEGER AS rank_size, 15 AS flat_size FROM stats WHERE cluster <> -1""", "binned")
def marker_scaling(spark, sf):
    return rp.marker_sizes(stats(spark, sf)).withColumn("log_size", six("log_size")).withColumn("root_size", six("root_size"))


@query(""", r AS (SELECT length(seq) AS l, sum(length(seq)) OVER (ORDER BY length(seq) DESC, read_idx) AS so_far, sum(length(seq)) OVER () AS total FROM reads)
  SELECT count(*) AS contigs, min(l)::BIGINT AS shortest, max(l)::BIGINT AS longest, round(avg(l), 6) AS mean, sum(l)::BIGINT AS total, (max(l) FILTER (so_far >= total // 2))::BIGINT AS n50 FROM r""")
def n50(spark, sf):
    return rp.contig_stats(rd.reads(spark, sf).select(F.length("seq").alias("length"))).withColumn("mean", six("mean"))


@query(f"SELECT id FROM reads WHERE {GC} > 0.4::DOUBLE INTERSECT SELECT id FROM reads WHERE length(seq) >= 100")
def id_intersection(spark, sf):
    r = rd.reads(spark, sf)
    return rp.id_intersection(r.where(gc_content(F.col("seq")) > 0.4), r.where(F.length("seq") >= 100))


@query("SELECT read_idx, cluster FROM binned WHERE cluster IN (1, 2)", "binned")
def cluster_union(spark, sf):
    return rp.cluster_union(rows(spark, sf).select("read_idx", "cluster"), 1, 2)


@query(f"""{STATS} SELECT cluster, printf('cluster_%d_size_%d_gc_%.3f_damage_%.3f.fasta', cluster, num_reads, avg_gc, avg_damage) AS name FROM stats WHERE cluster >= 0 AND num_reads >= 10""", "binned")
def export_file_names(spark, sf):
    return rp.exported(stats(spark, sf), 10).select("cluster", rp.export_name().alias("name"))


@query(f"""{ROWS}, xy AS (SELECT cluster, gc, combined AS damage, damage5 AS x, damage3 AS y FROM rows), ends AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy)
  SELECT cluster, least(63, floor((x - x0) / (x1 - x0) * 64))::INTEGER AS cell_x, least(63, floor((y - y0) / (y1 - y0) * 64))::INTEGER AS cell_y, count(*) AS n, round(avg(gc), 6) AS gc, round(avg(damage), 6) AS damage FROM xy, ends GROUP BY ALL""", "binned")
def scatter_cells(spark, sf):
    """The grid of a scatter, here over both ends' damage scores, which SQL gives too."""
    found = rp.scatter_cells(rows(spark, sf).withColumn("x", F.array("damage5", "damage3")))
    return found.withColumn("gc", six("gc")).withColumn("damage", six("damage"))


@query(f"""{STATS}, listed AS (SELECT list({{cluster: cluster, num_reads: num_reads, avg_gc: round(avg_gc, 4), avg_damage: round(avg_damage, 4), label: CASE WHEN cluster = -1 THEN 'Noise' ELSE concat('Cluster ', cluster::VARCHAR) END}} ORDER BY cluster) AS clusters FROM stats)
  SELECT to_json({{reads: (SELECT count(*) FROM rows), n_clusters: (SELECT count(*) FROM stats WHERE cluster <> -1), clusters: clusters}})::VARCHAR AS json FROM listed""", "binned")
def dashboard_json(spark, sf):
    return rp.dashboard_json(rows(spark, sf), stats(spark, sf))


@query(f"{STATS} SELECT cluster, num_reads, round(avg_gc, 6) AS avg_gc, {LABEL} AS taxonomy FROM stats WHERE num_reads >= 10", "binned")
def flagship(spark, sf):
    """Reads, quality control, features, clusters by GC, statistics and labels in one plan."""
    return labelled(spark, sf).where("num_reads >= 10").select("cluster", "num_reads", six("avg_gc").alias("avg_gc"), "taxonomy")
