"""Cluster profiles over k-mers: smoothed multinomials, the E-step, the M-step and merging.

Long form (DataFrames of cluster, kmer_idx) serves joins and reports. The loop in `em` keeps only the profiles on the
driver, clusters by 4^k numbers: one pass over the reads per round assigns every read and returns sums by cluster."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.kmers import Counts, pieces

PSEUDOCOUNT = 0.5
#: Numbers that the profiles of a model may have.
MAX_MODEL = 1 << 26


def min_initial_size(min_cluster_size: int = 10) -> int:
    return max(3, min_cluster_size // 10)


def initial_clusters(assigned: DataFrame, min_cluster_size: int = 10) -> DataFrame:
    """old, size and cluster: the clusters (not noise) that are large enough, numbered from 0 in order of their old id."""
    sizes = assigned.where("cluster >= 0").groupBy(F.col("cluster").alias("old")).agg(F.count(F.lit(1)).alias("size"))
    return renumbered(sizes.where(F.col("size") >= min_initial_size(min_cluster_size)), "old")


def renumbered(clusters: DataFrame, key: str) -> DataFrame:
    """A small table of clusters with `cluster`, 0 to n - 1 in order of the key."""
    return clusters.withColumn("cluster", F.expr(f"cast(row_number() over (order by {key}) - 1 as int)"))


def kmer_sums(assigned: DataFrame, k: int = 4) -> DataFrame:
    """cluster, kmer_idx, n: k-mer counts of the reads (seq, cluster) of each cluster, noise left out; a task returns at
    most clusters by 4^k rows."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                cluster, seqs = batch.column("cluster").to_numpy(zero_copy_only=False), batch.column("seq").to_pylist()
                for a, b in pieces(seqs):
                    known, place = np.unique(cluster[a:b], return_inverse=True)
                    own = np.zeros((len(known), 4**k))
                    Counts(seqs[a:b], k).add_to(own, np.where(cluster[a:b] >= 0, place, -1))
                    for c, x in zip(known.tolist(), own):
                        if c >= 0:
                            sums[c] = sums.get(c, 0) + x
        for c, own in sums.items():
            at = np.union1d(np.flatnonzero(own), [0])  # a row at least, so that every cluster is there
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], names=["cluster", "kmer_idx", "n"])

    # Noise is left out in the batch: a filter would be pushed below whatever computes the clusters.
    own = assigned.select("seq", F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster"))
    return own.mapInArrow(run, "cluster int, kmer_idx int, n long").groupBy("cluster", "kmer_idx").agg(F.sum("n").alias("n"))


def build_profiles(sums: DataFrame, k: int = 4, pseudocount: float = PSEUDOCOUNT) -> DataFrame:
    """cluster, kmer_idx, p, log_p from `kmer_sums`, every k-mer included."""
    domain = sums.select("cluster").distinct().select("cluster", F.explode(F.sequence(F.lit(0), F.lit(4**k - 1))).alias("kmer_idx"))
    full = domain.join(sums, ["cluster", "kmer_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.expr("sum(n) over (partition by cluster)")
    p = (F.col("n") + pseudocount) / (total + pseudocount * 4**k)
    return full.select("cluster", "kmer_idx", p.alias("p"), F.log(p).alias("log_p"))


def log_matrix(profiles: DataFrame, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the clusters, in order, and their log profiles: the model, clusters by 4^k numbers, on the driver."""
    rows = profiles.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).count()
    if rows * 4**k > MAX_MODEL:
        raise ValueError(f"{rows} profiles of {4**k} k-mers are too many for one model")
    numbers: dict[int, np.ndarray] = {}
    for r in profiles.select("cluster", "kmer_idx", "log_p").collect():
        numbers.setdefault(r.cluster, np.zeros(4**k))[r.kmer_idx] = r.log_p
    order = sorted(numbers)
    return np.array(order, np.int64), np.array([numbers[c] for c in order]).reshape(len(order), 4**k)


def best_clusters(reads: DataFrame, model: tuple[np.ndarray, np.ndarray], k: int = 4, kept: list[str] | None = None) -> DataFrame:
    """The kept columns (read_idx), cluster and ll of each read (seq) with k-mers: the best cluster, the lowest number of
    those that tie (to six decimals). Counts times log profiles in the batch; nothing is shuffled."""
    numbers, log_p = model
    kept = kept or ["read_idx"]
    types = {f.name: f.dataType.simpleString() for f in reads.schema}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                seqs = batch.column("seq").to_pylist()
                for a, b in pieces(seqs):
                    counts, part = Counts(seqs[a:b], k), batch.slice(a, b - a)
                    ll = counts.times(log_p)
                    best = np.round(ll, 6).argmax(axis=1)
                    out = [*[part.column(c) for c in kept], pa.array(numbers[best].astype(np.int32)), pa.array(ll[np.arange(len(ll)), best])]
                    yield pa.RecordBatch.from_arrays(out, names=[*kept, "cluster", "ll"]).filter(pa.array(counts.any()))

    return reads.select(*dict.fromkeys([*kept, "seq"])).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], "cluster int, ll double"]))


def total_likelihood(sums: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: the log likelihood of the reads behind `kmer_sums` under their own clusters' profiles (tables of clusters
    by 4^k rows)."""
    return sums.join(profiles, ["cluster", "kmer_idx"]).agg(F.sum(F.col("n") * F.col("log_p")).alias("ll"))


def divergences(profiles: DataFrame) -> DataFrame:
    """a, b, jsd (natural logarithm, 0 at least) of each pair of clusters a < b."""
    one, two = profiles.select(F.col("cluster").alias("a"), "kmer_idx", F.col("p").alias("p")), profiles.select(F.col("cluster").alias("b"), "kmer_idx", F.col("p").alias("q"))
    both = one.join(two, "kmer_idx").where("a < b").withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when((F.col(c) > 0) & (F.col("m") > 0), F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return both.groupBy("a", "b").agg(F.greatest(F.lit(0.0), 0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))).alias("jsd"))


def most_similar(pairs: DataFrame) -> DataFrame:
    """The pair with the least divergence; the first in order wins ties."""
    return pairs.orderBy("jsd", "a", "b").limit(1)


def bic(ll: Column, clusters: Column, reads: Column, k: int = 4) -> Column:
    return -2 * ll + (clusters * (4**k - 1) + clusters - 1) * F.log(reads.cast("double"))


def relabelled(assigned: DataFrame, a: int | Column, b: int | Column) -> DataFrame:
    """Cluster b becomes a, and numbers above b go down by one."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    c = F.col("cluster")
    return assigned.withColumn("cluster", F.when(c == b, a).when(c > b, c - 1).otherwise(c))


def assignment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select("read_idx", F.col("cluster").alias("old")).join(new.select("read_idx", F.col("cluster").alias("new")), "read_idx")
    return both.agg(F.count_if(F.col("old") != F.col("new")).alias("changes"), F.count(F.lit(1)).alias("reads"))


# --- the same on dense arrays, for the loop on the driver


def smooth(sums: np.ndarray, pseudocount: float = PSEUDOCOUNT) -> np.ndarray:
    """Profiles from sums, clusters by k-mers."""
    return (sums + pseudocount) / (sums.sum(axis=1, keepdims=True) + pseudocount * sums.shape[1])


def log_likelihood(counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Reads by clusters; zero counts add nothing."""
    return counts @ log_p.T


def divergences_from(p: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon divergence of one profile from each of others."""
    m = (p + others) / 2
    part = lambda x: (x * np.log(np.where(x > 0, x, 1) / np.where(m > 0, m, 1))).sum(axis=-1)
    return np.maximum(0.0, 0.5 * part(np.broadcast_to(p, m.shape)) + 0.5 * part(others))


def jsd(p: np.ndarray, q: np.ndarray) -> float:
    return float(divergences_from(p, q[None, :])[0])


def bic_value(ll: float, clusters: int, reads: int, kmers: int) -> float:
    return -2 * ll + (clusters * (kmers - 1) + clusters - 1) * float(np.log(max(reads, 1)))


class Merges:
    """The clusters of a model, of which the least divergent two are joined while that lowers the BIC; likelihoods follow from
    the sums, so no read is looked at. Each cluster knows its nearest one among those after it. A heap holds these pairs;
    an entry counts only if both clusters are as they were when it was made. After a merge, one row of divergences is
    computed, and one for each cluster whose nearest was one of the two, as arrays over the clusters."""

    ROWS = 1 << 22  # numbers of a block of divergences

    def __init__(self, sums: np.ndarray, sizes: np.ndarray, gc: np.ndarray, pseudocount: float = PSEUDOCOUNT):
        self.sums, self.sizes, self.gc, self.pseudocount = sums.copy(), sizes.copy(), gc.copy(), pseudocount
        self.profiles = smooth(self.sums, pseudocount)
        self.own = (self.sums * np.log(self.profiles)).sum(axis=1)
        self.alive = np.ones(len(sums), bool)
        self.version = np.zeros(len(sums), np.int64)
        self.into = np.arange(len(sums))  # by cluster: what it was joined with
        self.heap: list[tuple[float, int, int, int, int]] = []
        self.nearest, self.distance = np.full(len(sums), -1), np.full(len(sums), np.inf)
        for i in range(len(sums) - 1):
            self._search(i)

    def _row(self, i: int, others: np.ndarray) -> np.ndarray:
        step = max(1, self.ROWS // self.sums.shape[1])
        parts = [divergences_from(self.profiles[i], self.profiles[others[a : a + step]]) for a in range(0, len(others), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _offer(self, i: int, j: int, d: float) -> None:
        self.nearest[i], self.distance[i] = j, d
        heapq.heappush(self.heap, (float(d), i, j, int(self.version[i]), int(self.version[j])))

    def _search(self, i: int) -> None:
        others = np.flatnonzero(self.alive[i + 1 :]) + i + 1
        self.nearest[i], self.distance[i] = -1, np.inf
        if len(others):
            row = self._row(i, others)
            self._offer(i, int(others[row.argmin()]), row.min())

    def best(self) -> tuple[int, int] | None:
        """The least divergent pair; the first in order wins ties."""
        while self.heap:
            _, i, j, a, b = self.heap[0]
            if self.alive[i] and self.alive[j] and self.version[i] == a and self.version[j] == b and self.nearest[i] == j:
                return i, j
            heapq.heappop(self.heap)
        return None

    def step(self, reads: int) -> tuple[int, int] | None:
        """Joins the best pair, if that lowers the BIC."""
        pair, clusters = self.best(), int(self.alive.sum())
        if pair is None:
            return None
        i, j = pair
        joint = self.sums[i] + self.sums[j]
        profile = smooth(joint[None, :], self.pseudocount)[0]
        own, total = float((joint * np.log(profile)).sum()), float(self.own[self.alive].sum())
        if bic_value(total - self.own[i] - self.own[j] + own, clusters - 1, reads, len(joint)) >= bic_value(total, clusters, reads, len(joint)):
            return None
        self.sums[i], self.profiles[i], self.own[i] = joint, profile, own
        self.sizes[i] += self.sizes[j]
        self.gc[i] += self.gc[j]
        self.alive[j] = False
        self.into[self.into == j] = i
        self.version[i] += 1
        others = np.flatnonzero(self.alive)
        others = others[others != i]
        row = self._row(i, others)
        after = others > i
        self.nearest[i], self.distance[i] = -1, np.inf
        if after.any():
            at = int(np.where(after, row, np.inf).argmin())
            self._offer(i, int(others[at]), row[at])
        for c, d in zip(others[~after].tolist(), row[~after].tolist()):
            if self.nearest[c] in (i, j):
                self._search(c)
            elif (d, i) < (self.distance[c], self.nearest[c]):
                self._offer(c, i, d)
        for c in others[after].tolist():
            if self.nearest[c] == j:
                self._search(c)
        return pair

    def left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums, sizes and GC sums of the clusters that are left, and the new number of each cluster."""
        number = np.cumsum(self.alive) - 1
        return self.sums[self.alive], self.sizes[self.alive], self.gc[self.alive], number[self.into]


def merge_step(sums: np.ndarray, reads: int, pseudocount: float = PSEUDOCOUNT) -> tuple[int, int] | None:
    """The least divergent pair, if joining it lowers the BIC."""
    return Merges(sums, np.zeros(len(sums)), np.zeros(len(sums)), pseudocount).step(reads)
