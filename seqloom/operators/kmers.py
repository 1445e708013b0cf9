"""K-mer counts and frequencies, counted in the batch that holds the read: in long form and as matrices."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COUNT = 65_535
_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def enumerate_kmers(spark: SparkSession, k: int) -> DataFrame:
    """kmer_idx and kmer, all of length k in lexicographic order (the empty one for k = 0)."""
    digit = lambda j: F.substr(F.lit("ACGT"), (F.floor(F.col("kmer_idx") / 4 ** (k - 1 - j)) % 4 + 1).cast("int"), F.lit(1))
    return spark.range(4**k).select(F.col("id").cast("int").alias("kmer_idx")).withColumn("kmer", F.concat(F.lit(""), *[digit(j) for j in range(k)]))


def _counted(reads: DataFrame, kept: list[str], schema: str, count) -> DataFrame:
    """The kept columns beside the rows that `count` makes of a batch's sequences: the read's place, then the columns of
    `schema`. The windows of a read stay in its task, so nothing is shuffled."""
    types = {f.name: f.dataType.simpleString() for f in reads.schema}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                owner, *columns = count([s or "" for s in batch.column("seq").to_pylist()])
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], *map(pa.array, columns)], names=[*kept, *names_of])

    names_of = [c.split()[0] for c in schema.split(", ")]
    return reads.select(*kept, "seq").mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], schema]))


def _tally(owner: np.ndarray, index: np.ndarray, width: int, reads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read, index and number of each index that a read has."""
    if width <= 256:
        dense = np.bincount(owner * width + index, minlength=reads * width)
        key = np.flatnonzero(dense)
        return key // width, key % width, dense[key]
    key, n = np.unique(owner * width + index, return_counts=True)
    return key // width, key % width, n


def kmer_frequencies(reads: DataFrame, k: int, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (read_idx), kmer, freq: case-sensitive k-mers of ACGT over all windows, those with other letters
    included."""
    every = pa.array(names(k)) if k <= 8 else None

    def count(seqs):
        owner, index, sizes = _windows(seqs, k, False)
        owner, index, n = _tally(owner, index, 4**k, len(seqs))
        kmers = every.take(pa.array(index)) if every is not None else ["".join("ACGT"[i >> 2 * j & 3] for j in reversed(range(k))) for i in index.tolist()]
        return owner, kmers, n / (sizes[owner] - k + 1)

    return _counted(reads, kept or ["read_idx"], "kmer string, freq double", count)


def kmer_counts(reads: DataFrame, k: int, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (read_idx), kmer_idx, n: windows in either case with letters of ACGT only; counts end at 65,535."""

    def count(seqs):
        owner, index, _ = _windows(seqs, k, True)
        owner, index, n = _tally(owner, index, 4**k, len(seqs))
        return owner, index.astype(np.int32), np.minimum(n, MAX_COUNT).astype(np.int32)

    return _counted(reads, kept or ["read_idx"], "kmer_idx int, n int", count)


def codon_usage(reads: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (read_idx), codon, freq: triplets of frame 0, over the number of whole triplets."""

    def count(seqs):
        whole = np.array([len(s) // 3 for s in seqs], np.int64)
        code = np.frombuffer("".join(s[: 3 * n] for s, n in zip(seqs, whole.tolist())).encode("ascii", "replace"), np.uint8).reshape(-1, 3).astype(np.int64)
        key, n = np.unique(np.repeat(np.arange(len(seqs)), whole) << 24 | code[:, 0] << 16 | code[:, 1] << 8 | code[:, 2], return_counts=True)
        owner, codon = key >> 24, np.stack([key >> 16 & 255, key >> 8 & 255, key & 255], axis=1).astype(np.uint8)
        return owner, [c.decode() for c in codon.tobytes() and codon.view("S3")[:, 0].tolist()], n / whole[owner]

    return _counted(reads, kept or ["read_idx"], "codon string, freq double", count)


def _windows(seqs: list[str], k: int, upper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and index of every window of ACGT only, and the lengths."""
    raw = np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)
    code = _CODE[raw] if upper else np.where((raw >= 97) & (raw <= 122), 4, _CODE[raw])
    sizes = np.array([len(s) for s in seqs], np.int64)
    n = max(len(code) - k + 1, 0)
    index, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(k):
        part = code[j : j + n]
        index = index * 4 + part
        bad |= part > 3
    owner = np.repeat(np.arange(len(seqs)), sizes)[:n]
    left = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n)  # bases from here to the end of the read
    good = ~bad & (left >= k)
    return owner[good], index[good], sizes


def count_matrix(seqs: list[str], k: int) -> np.ndarray:
    """Reads by 4^k counts (either case, saturating)."""
    owner, index, _ = _windows(seqs, k, True)
    return np.minimum(np.bincount(owner * 4**k + index, minlength=len(seqs) * 4**k).reshape(len(seqs), 4**k), MAX_COUNT).astype(np.float64)


#: K-mers up to which the counts of a batch are a matrix; more are kept as rows of index and number.
DENSE = 1024
#: Bases whose counts are held at once, and numbers that a step over clusters may make of them.
HELD_BASES = 1 << 20


def pieces(seqs: list[str], limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of reads with at most `limit` bases together, or one read."""
    limit = HELD_BASES if limit is None else limit
    start = held = 0
    for i, s in enumerate(seqs):
        if i > start and held + len(s) > limit:
            yield start, i
            start, held = i, 0
        held += len(s)
    if len(seqs) > start:
        yield start, len(seqs)


class Counts:
    """The counts of some reads: a matrix for few k-mers, else compressed rows, so that a read costs what it holds."""

    def __init__(self, seqs: list[str], k: int):
        self.reads, self.width = len(seqs), 4**k
        self.matrix = count_matrix(seqs, k) if self.width <= DENSE else None
        if self.matrix is None:
            owner, index, _ = _windows(seqs, k, True)
            self.owner, self.index, n = _tally(owner, index, self.width, self.reads)
            self.n = np.minimum(n, MAX_COUNT).astype(np.float64)

    def any(self) -> np.ndarray:
        """Which reads have k-mers."""
        return self.matrix.any(axis=1) if self.matrix is not None else np.bincount(self.owner, minlength=self.reads) > 0

    def times(self, columns: np.ndarray) -> np.ndarray:
        """Reads by columns: the counts times a matrix of columns by k-mers."""
        if self.matrix is not None:
            return self.matrix @ columns.T
        out = np.empty((self.reads, len(columns)))
        for c, own in enumerate(columns):
            out[:, c] = np.bincount(self.owner, self.n * own[self.index], self.reads)
        return out

    def add_to(self, sums: np.ndarray, cluster: np.ndarray, sign: float = 1.0) -> None:
        """Adds the counts of each read to the row of its cluster (below 0: none)."""
        if self.matrix is not None:
            own = cluster >= 0
            mark = np.zeros((len(sums), self.reads))
            mark[cluster[own], np.flatnonzero(own)] = sign
            sums += mark @ self.matrix
            return
        to = cluster[self.owner]
        own = to >= 0
        np.add.at(sums, (to[own], self.index[own]), sign * self.n[own])


def frequency_matrix(seqs: list[str], k: int) -> np.ndarray:
    """Reads by 4^k frequencies (case-sensitive, over all windows)."""
    owner, index, sizes = _windows(seqs, k, False)
    counts = np.bincount(owner * 4**k + index, minlength=len(seqs) * 4**k).reshape(len(seqs), 4**k)
    return counts / np.maximum(sizes - k + 1, 1)[:, None]


def frequency_rows(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as owner, index and frequency of the k-mers that a read has."""
    owner, index, sizes = _windows(seqs, k, False)
    owner, index, n = _tally(owner, index, 4**k, len(seqs))
    return owner, index, n / np.maximum(sizes - k + 1, 1)[owner]


def gc_array(seqs: list[str]) -> np.ndarray:
    return np.array([(s.count("G") + s.count("C") + s.count("g") + s.count("c")) / len(s) if s else 0.0 for s in seqs])


def names(k: int) -> list[str]:
    return ["".join(p) for p in itertools.product("ACGT", repeat=k)]
