"""Mate pairs: the join, mismatches between a mate and the reverse complement of the other, and support scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import base_id, mate

DEFAULT_SUPPORT, MIN_OVERLAP = 0.5, 10
PATTERNS = ("CT5", "GA3", "CT3", "GA5", "Other")
CT5, GA3, CT3, GA5, OTHER = range(5)
A, C, G, T = range(4)
COMPLEMENT = np.array([3, 2, 1, 0, 4])
CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i


def by_base_id(reads: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """The reads with base_id and mate, written as a table of that name at a path in the shared folder, in buckets of base
    ids: mate joins, support and evidence of these rows shuffle no read again."""
    with_mate(reads).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "base_id").sortBy("base_id").saveAsTable(table)
    return reads.sparkSession.table(table)


def with_mate(reads: DataFrame) -> DataFrame:
    if {"base_id", "mate"} <= set(reads.columns):
        return reads
    return reads.withColumn("base_id", base_id(F.col("id"))).withColumn("mate", mate(F.col("id")))


def mate_join(reads: DataFrame) -> DataFrame:
    """base_id, seq1, seq2 (and qual1, qual2 if the reads have `quality`): mate 1 with mate 2, the last of each if an id
    occurs more than once. The last is by `read_idx` where there is one, else by sequence."""
    named = with_mate(reads).where(F.col("mate") > 0)
    payload = F.struct(*[c for c in ("read_idx", "seq", "quality") if c in reads.columns])
    last = lambda m: F.max(F.when(F.col("mate") == m, payload))
    pairs = named.groupBy("base_id").agg(last(1).alias("a"), last(2).alias("b")).where("a is not null and b is not null")
    quality = [F.col("a.quality").alias("qual1"), F.col("b.quality").alias("qual2")] if "quality" in reads.columns else []
    return pairs.select("base_id", F.col("a.seq").alias("seq1"), F.col("b.seq").alias("seq2"), *quality)


class Places:
    """The differing places of a batch of pairs, as arrays: pair, pos, codes of both bases, pattern and both qualities (-1:
    none). Only places where both bases are of ACGT count, in either case; none if mate 1 is longer than mate 2, or below ten
    bases."""

    def __init__(self, batch: pa.RecordBatch):
        seq1, seq2 = ([s or "" for s in batch.column(c).to_pylist()] for c in ("seq1", "seq2"))
        self.size1, self.size2 = (np.array(list(map(len, s)), np.int64) for s in (seq1, seq2))
        self.overlap = np.where((self.size1 >= MIN_OVERLAP) & (self.size2 > 0), self.size1, 0)
        used = np.where(self.size1 <= self.size2, self.overlap, 0)
        pair = np.repeat(np.arange(len(used)), used)
        pos = np.arange(len(pair)) - np.repeat(np.cumsum(used) - used, used)
        one, two = (CODE[np.frombuffer("".join(s).encode("ascii", "replace"), np.uint8)] for s in (seq1, seq2))
        base1 = one[np.repeat(np.cumsum(self.size1) - self.size1, used) + pos]
        base2 = COMPLEMENT[two[np.repeat(np.cumsum(self.size2) - 1, used) - pos]]  # mate 2 from its end
        at = np.flatnonzero((base1 != base2) & (base1 < 4) & (base2 < 4))
        self.pair, self.pos, self.base1, self.base2 = pair[at], pos[at], base1[at], base2[at]
        length = self.size1[self.pair]
        near = np.minimum(10, length // 5)
        near5, near3 = self.pos < near, self.pos >= length - near
        is_ = lambda one, two: (self.base1 == one) & (self.base2 == two)
        self.pattern = np.select([near5 & is_(T, C), near3 & is_(A, G), near3 & is_(G, A), near5 & is_(C, T)], [CT5, GA3, CT3, GA5], OTHER)
        self.length = length
        self.quality = [self._quality(batch, c) for c in ("qual1", "qual2")]

    def _quality(self, batch: pa.RecordBatch, column: str) -> np.ndarray:
        if column not in batch.schema.names:
            return np.full(len(self.pair), -1)
        own = batch.column(column)
        values = np.append(own.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
        size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = (np.cumsum(size) - size)[self.pair] + self.pos
        return values[np.where(self.pos < size[self.pair], at, len(values) - 1)]

    def counts(self, *patterns: int) -> np.ndarray:
        return np.bincount(self.pair[np.isin(self.pattern, patterns)], minlength=len(self.size1))

    def support(self) -> np.ndarray:
        """The support of each pair: the share of damage patterns, and how near they lie to the ends, weighed by quality."""
        q1, q2 = self.quality
        low = np.minimum(q1, q2)
        weight = np.select([low < 0, low > 20, low > 15], [0.7, 1.0, 0.8], 0.5)
        distance = np.where(np.isin(self.pattern, (CT5, GA5)), self.pos, self.length - self.pos)
        damaged = self.pattern != OTHER
        sums = lambda w: np.bincount(self.pair[damaged], w[damaged], len(self.size1))
        weights, near = sums(weight), sums(np.minimum(10 / (distance + 1), 1.0) * weight)
        main, other = self.counts(CT5, GA3), self.counts(OTHER)
        total = main + other
        ends = np.where(weights > 0, near / np.where(weights > 0, weights, 1), 0.5)
        score = np.clip(0.7 * main / np.maximum(total, 1) + 0.3 * ends, 0.0, 1.0)
        return np.where(self.overlap == 0, 0.0, np.where(total == 0, DEFAULT_SUPPORT, score))


def _in_batch(pairs: DataFrame, schema: str, rows) -> DataFrame:
    """What `rows` makes of a batch of pairs and its places; a pair's bases never leave its task."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield rows(batch, Places(batch))

    return pairs.select("base_id", "seq1", "seq2", *[c for c in ("qual1", "qual2") if c in pairs.columns]).mapInArrow(run, schema)


def mismatches(pairs: DataFrame) -> DataFrame:
    """base_id, pos, base1, base2, pattern, length (of mate 1), qual1 and qual2 (null: none) of each differing place."""

    def rows(batch, p):
        quality = [pa.array(q, pa.int32(), mask=q < 0) for q in p.quality]
        letters, kinds = pa.array(list("ACGT")), pa.array(PATTERNS)
        return pa.RecordBatch.from_arrays(
            [batch.column("base_id").take(pa.array(p.pair)), pa.array(p.pos.astype(np.int32)), letters.take(pa.array(p.base1)), letters.take(pa.array(p.base2)), kinds.take(pa.array(p.pattern)), pa.array(p.length.astype(np.int32)), *quality],
            names=["base_id", "pos", "base1", "base2", "pattern", "length", "qual1", "qual2"],
        )

    return _in_batch(pairs, "base_id string, pos int, base1 string, base2 string, pattern string, length int, qual1 int, qual2 int", rows)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """base_id, overlap_size, has_overlap, c_to_t, g_to_a, other, support of every pair. The overlap is the length of mate 1,
    as the alignment takes all of it; below ten bases, or without mate 2's, there is none and its size is 0."""

    def rows(batch, p):
        arrays = [p.overlap.astype(np.int32), p.overlap > 0, p.counts(CT5, GA5), p.counts(GA3, CT3), p.counts(OTHER), p.support()]
        return pa.RecordBatch.from_arrays([batch.column("base_id"), *map(pa.array, arrays)], names=["base_id", "overlap_size", "has_overlap", "c_to_t", "g_to_a", "other", "support"])

    return _in_batch(pairs, "base_id string, overlap_size int, has_overlap boolean, c_to_t long, g_to_a long, other long, support double", rows)


def support_of_reads(reads: DataFrame) -> DataFrame:
    """id and support of every read: its pair's, or the default without a mate."""
    summary = pair_summary(mate_join(reads)).select("base_id", "support")
    return with_mate(reads).select("id", "base_id").join(summary, "base_id", "left").select("id", F.coalesce("support", F.lit(DEFAULT_SUPPORT)).alias("support"))


def with_evidence(reads: DataFrame) -> DataFrame:
    """The reads with support, ratio (the damage patterns' share of mismatches), mismatches and overlap_size of their
    pair; null without a mate."""
    hits = F.col("c_to_t") + F.col("g_to_a")
    total = hits + F.col("other")
    summary = pair_summary(mate_join(reads)).select("base_id", "support", F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("ratio"), total.alias("mismatches"), "overlap_size")
    named = reads if "base_id" in reads.columns else reads.withColumn("base_id", base_id(F.col("id")))
    return named.join(summary, "base_id", "left").select(*reads.columns, *summary.columns[1:])


def pair_counters(reads: DataFrame) -> DataFrame:
    """One row: what a cache of mates counts when reads come one after the other (in order of read_idx, or mates 1 first
    without it), and are then all looked up. A named read is inserted; it finds its pair if a read of the other mate waits,
    and else waits itself. An alignment is made for each base id with both mates; a lookup hits if its base id has one."""
    named = with_mate(reads)
    order = F.col("read_idx") if "read_idx" in reads.columns else F.col("mate")
    number = [F.count_if(F.col("mate") == m).alias(f"n{m}") for m in (0, 1, 2)]
    sides = named.groupBy("base_id").agg(*number, F.min(F.when(F.col("mate") > 0, F.struct(order.alias("o"), "mate"))).alias("first"))
    waits = F.when(F.col("first.mate") == 1, F.col("n1")).when(F.col("first.mate") == 2, F.col("n2")).otherwise(0)
    both, paired = F.col("n1") + F.col("n2"), (F.col("n1") > 0) & (F.col("n2") > 0)
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sides.agg(
        of(both + F.col("n0")).alias("lookups"), of(F.when(paired, both + F.col("n0"))).alias("hits"), of(both).alias("inserts"), of(both - waits).alias("pair_found"),
        of(waits).alias("pair_not_found"), of(F.col("n0")).alias("unnamed"), F.count_if(paired).alias("alignments"),
    )
