"""Cluster statistics, labels and what reports and the dashboard show."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = -1


def cluster_stats(rows: DataFrame) -> DataFrame:
    """cluster, num_reads, avg_gc, avg_damage, avg_damage5, avg_damage3 from rows with cluster, gc and damage."""
    avg = lambda c, d: F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(d)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("num_reads"), avg("gc", "avg_gc"), avg("combined", "avg_damage"), avg("damage5", "avg_damage5"), avg("damage3", "avg_damage3"))


def taxonomy(cluster: Column, gc: Column, damage: Column, threshold: float = 0.5) -> Column:
    """Noise, or the bin's number with its GC class and whether its damage reaches the threshold."""
    level = F.when(gc < 0.3, "very-low-GC").when(gc < 0.4, "low-GC").when(gc < 0.5, "mid-GC").when(gc < 0.6, "high-GC").otherwise("very-high-GC")
    age = F.when(damage >= threshold, "ancient").otherwise("modern/ambiguous")
    return F.when(cluster == NOISE, "Noise").otherwise(F.concat(F.lit("Bin "), cluster.cast("string"), F.lit(" ["), level, F.lit(", "), age, F.lit("]")))


def dashboard_label(cluster: Column) -> Column:
    return F.when(cluster == NOISE, "Noise").otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))


# The headers of the report.
REPORT = ("Cluster ID", "Number of Reads", "Avg GC Content", "Avg Damage Score", "Avg 5' Damage", "Avg 3' Damage", "Taxonomy")


def report_rows(stats: DataFrame) -> DataFrame:
    """The seven columns of the report, as text, numbers to four decimals."""
    four = lambda c: F.format_string("%.4f", c)
    values = [F.col("cluster").cast("string"), F.col("num_reads").cast("string"), *[four(c) for c in ("avg_gc", "avg_damage", "avg_damage5", "avg_damage3")], F.col("taxonomy")]
    return stats.select(*[v.alias(n) for v, n in zip(values, REPORT)])


def global_summary(rows: DataFrame) -> DataFrame:
    """One row: reads, clusters without noise, percentage of noise, mean damage."""
    noise = F.col("cluster") == NOISE
    return rows.agg(
        F.count(F.lit(1)).alias("reads"), F.count_distinct(F.when(~noise, F.col("cluster"))).alias("clusters"),
        (100.0 * F.count_if(noise) / F.count(F.lit(1))).alias("noise_percent"), F.avg("combined").alias("mean_damage"),
    )


def explained_percent(retained: list[float], every: list[float]) -> tuple[list[float], list[float]]:
    """Percentages of the retained eigenvalues' sum, as shown in reports, and of the whole variance."""
    share = lambda total: [100.0 * v / total if total else 0.0 for v in retained]
    return share(sum(retained)), share(sum(every))


def min_size_filter(rows: DataFrame, min_size: int = 5) -> DataFrame:
    """Rows of noise and of clusters of at least this size. Sizes come from a grouped count, joined back."""
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") >= min_size) | (F.col("cluster") == NOISE))
    return rows.join(sizes.select("cluster"), "cluster", "left_semi")


def damage_histogram(rows: DataFrame, bins: int = 30) -> DataFrame:
    """end, bin, n: counts of both damage scores in bins of equal width over 0 to 1."""
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"damage{e}").alias("v")) for e in (5, 3)])
    return rows.select(F.inline(ends)).groupBy("end", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("v") * bins).cast("int"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def by_size(stats: DataFrame) -> DataFrame:
    """Clusters without noise, with their percentage of the largest."""
    own = stats.where(F.col("cluster") != NOISE)
    return own.withColumn("percent_of_max", F.expr("100.0D * num_reads / max(num_reads) over ()"))


def top_clusters(stats: DataFrame, n: int = 10) -> DataFrame:
    return by_size(stats).orderBy(F.desc("num_reads"), "cluster").limit(n)


def marker_sizes(stats: DataFrame) -> DataFrame:
    """Four scalings of a cluster's marker: by logarithm, by root, by rank, and none."""
    n = F.col("num_reads")
    rank = F.expr("row_number() over (order by num_reads desc, cluster) - 1")
    return by_size(stats).select("cluster", "num_reads", F.greatest(F.lit(10.0), F.log10(n) * 15).alias("log_size"), F.greatest(F.lit(5.0), F.sqrt(n / 100) * 20).alias("root_size"), (40 - 2 * rank).cast("int").alias("rank_size"), F.lit(15).alias("flat_size"))


def contig_stats(lengths: DataFrame, column: str = "length") -> DataFrame:
    """One row: contigs, shortest, longest, mean, total and N50. Sums run over counts by length, not over contigs."""
    by_length = lengths.groupBy(F.col(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    summed = by_length.agg(F.sum("n").alias("contigs"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.sum(F.col("length") * F.col("n")).alias("total"))
    running = by_length.select("length", F.expr("sum(length * n) over (order by length desc rows between unbounded preceding and current row)").alias("so_far"))
    n50 = running.join(F.broadcast(summed.select("total"))).where(F.expr("so_far >= total div 2")).agg(F.max("length").alias("n50"))
    return summed.join(F.broadcast(n50)).select("contigs", "shortest", "longest", (F.col("total") / F.col("contigs")).alias("mean"), "total", "n50")


def export_name(extension: str = "fasta") -> Column:
    return F.format_string(f"cluster_%d_size_%d_gc_%.3f_damage_%.3f.{extension}", "cluster", "num_reads", "avg_gc", "avg_damage")


def exported(stats: DataFrame, min_size: int = 0) -> DataFrame:
    return stats.where((F.col("cluster") >= 0) & (F.col("num_reads") >= min_size))


def id_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def cluster_union(rows: DataFrame, a: int, b: int) -> DataFrame:
    """The reads of both clusters, repeated ones included."""
    return rows.where(F.col("cluster") == a).unionByName(rows.where(F.col("cluster") == b))


def scatter_cells(points: DataFrame, cells: int = 64) -> DataFrame:
    """cluster, cell_x, cell_y, n, gc, damage: the reads by cluster over a square grid of their first two components `x`,
    with the means that colour a cell. Every read counts; the rows are at most clusters times cells squared. The grid spans
    the least to the largest value of each component (one column or row of cells where they are equal)."""
    xy = points.select("cluster", F.coalesce("gc", F.lit(0.0)).alias("gc"), F.coalesce("combined", F.lit(0.0)).alias("damage"), F.element_at("x", 1).alias("x"), F.when(F.size("x") > 1, F.col("x")[1]).otherwise(F.lit(0.0)).alias("y"))
    ends = xy.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).first()

    def cell(c: str):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if low is None or high <= low:
            return F.lit(0)
        return F.least(F.lit(cells - 1), F.floor((F.col(c) - low) / (high - low) * cells).cast("int"))

    counted = xy.groupBy("cluster", cell("x").alias("cell_x"), cell("y").alias("cell_y"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg("gc").alias("gc"), F.avg("damage").alias("damage"))


def dashboard_json(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """One row, `json`: totals and the clusters by number."""
    clusters = stats.select(F.struct("cluster", "num_reads", F.round("avg_gc", 4).alias("avg_gc"), F.round("avg_damage", 4).alias("avg_damage"), dashboard_label(F.col("cluster")).alias("label")).alias("c")).agg(F.sort_array(F.collect_list("c")).alias("clusters"))
    totals = global_summary(rows).select("reads", F.col("clusters").alias("n_clusters"))
    return totals.join(F.broadcast(clusters)).select(F.to_json(F.struct("reads", "n_clusters", "clusters")).alias("json"))


def reference_bitmaps(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, bucket and bits: the distinct references that the mapped reads of a cluster lie on, as bitmaps of 32,768
    references each. A row has 4 kB whatever the number of records, and tasks merge what they have before the shuffle."""
    mapped = records.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("tid") >= 0)).select("id", (F.col("tid").cast("long") + 1).alias("place"))
    found = mapped.join(clusters.select("id", "cluster"), "id").select("cluster", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    return found.groupBy("cluster", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def references(bucket: int, bits: bytes) -> np.ndarray:
    """The references in a bitmap, in order."""
    return (bucket - 1) * 32_768 + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def references_by_cluster(records: DataFrame, clusters: DataFrame) -> dict[int, np.ndarray]:
    """The references of each cluster on the driver, for the headers of its files: as many bitmaps as clusters have buckets."""
    parts: dict[int, list] = {}
    for r in reference_bitmaps(records, clusters).orderBy("cluster", "bucket").collect():
        parts.setdefault(r.cluster, []).append(references(r.bucket, r.bits))
    return {c: np.concatenate(own) for c, own in parts.items()}
