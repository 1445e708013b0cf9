"""Quality control: filters and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECONDARY, SUPPLEMENTARY, UNMAPPED = 0x100, 0x800, 0x4


def long_enough(reads: DataFrame, min_length: int = 30) -> DataFrame:
    return reads.where(F.length("seq") >= min_length)


def counters(reads: DataFrame, min_length: int = 30) -> DataFrame:
    """One row: total, short and passed reads."""
    short = F.length("seq") < min_length
    return reads.agg(F.count(F.lit(1)).alias("total"), F.count_if(short).alias("short"), F.count_if(~short).alias("passed"))


def alignment_step(bam_filter: str = "all", min_length: int = 30):
    """The first test that a record fails: secondary, supplementary, mapping, short; or passed."""
    flag = F.col("flag")
    unmapped = flag.bitwiseAND(UNMAPPED) != 0
    mapping = {"all": F.lit(False), "mapped": unmapped, "unmapped": ~unmapped}[bam_filter]
    return (
        F.when(flag.bitwiseAND(SECONDARY) != 0, "secondary").when(flag.bitwiseAND(SUPPLEMENTARY) != 0, "supplementary")
        .when(mapping, "mapping").when(F.length("seq") < min_length, "short").otherwise("passed")
    )


def passed_alignments(records: DataFrame, bam_filter: str = "all", min_length: int = 30) -> DataFrame:
    if {"secondary", "supplementary", "unmapped", "length"} <= set(records.columns):  # tests that reach the reader
        mapping = {"all": F.lit(True), "mapped": ~F.col("unmapped"), "unmapped": F.col("unmapped")}[bam_filter]
        return records.where(~F.col("secondary") & ~F.col("supplementary") & mapping & (F.col("length") >= min_length))
    return records.where(alignment_step(bam_filter, min_length) == "passed")


def alignment_counters(records: DataFrame, bam_filter: str = "all", min_length: int = 30) -> DataFrame:
    step = records.select(alignment_step(bam_filter, min_length).alias("step"), (F.col("flag").bitwiseAND(UNMAPPED) != 0).alias("unmapped"))
    of = lambda s: F.count_if(F.col("step") == s).alias(s)
    mapping = [F.count_if(~F.col("unmapped")).alias("mapped"), F.count_if(F.col("unmapped")).alias("unmapped")]  # of all records
    return step.agg(F.count(F.lit(1)).alias("total"), *mapping, of("secondary"), of("supplementary"), of("short"), of("passed"))


def consistent(reads: DataFrame, *sides: DataFrame) -> DataFrame:
    """The reads whose id is in every side table."""
    for side in sides:
        reads = reads.join(side.select("id"), "id", "left_semi")
    return reads


def consistency_report(reads: DataFrame, sample: int = 100, **sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counters (reads, kept, missing from each side), and up to `sample` reads that are missing somewhere."""
    marked = reads.select("id")
    for name, side in sides.items():
        marked = marked.join(side.select("id").distinct().withColumn(f"in_{name}", F.lit(True)), "id", "left")
    inside = [F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in sides]
    every = inside[0]
    for other in inside[1:]:
        every = every & other
    counts = marked.agg(F.count(F.lit(1)).alias("reads"), F.count_if(every).alias("kept"), *[F.count_if(~i).alias(f"missing_{n}") for n, i in zip(sides, inside)])
    return counts, marked.where(~every).select("id").limit(sample)


def with_side(reads: DataFrame, side: DataFrame, default: dict) -> DataFrame:
    """Left join with a table by id; missing values take their default."""
    joined = reads.join(side, "id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})
