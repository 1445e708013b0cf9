"""Reads as a stream: the narrow stages (quality control, GC, damage) hold no state, so they run over a stream as they
are; clustering needs the whole table and stays a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import gc_content
from seqloom.operators import damage, qc


def measured_stream(reads: DataFrame, min_length: int = 30, window: int = 5) -> DataFrame:
    """A stream of reads with read_idx and seq to a stream with gc and the three damage scores."""
    kept = qc.long_enough(reads, min_length)
    return damage._mapped(
        kept.select("read_idx", "seq", gc_content(F.col("seq")).alias("gc")), ["read_idx", "gc"],
        lambda f: damage.assess(f["seq"].tolist(), window), {c: "double" for c in ("damage5", "damage3", "combined")},
    )
