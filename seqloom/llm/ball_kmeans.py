"""Exact k-means over whole numbers with clusters as balls.

A round knows, for each cluster, its new centroid and a bound of its radius: the farthest member from the old centroid, plus
how far the centroid moved. Only centroids within two radii are its neighbours. A member no farther than half the way to
the nearest neighbour is in the stable core and stays; the others lie in annuli, between half the ways to the i-th and the
next neighbour, and are compared with the first i neighbours only. All of it is done on whole numbers (squared distances
in 64 bits), so that assignments are those of plain Lloyd rounds, ties included.

The driver holds the model: clusters by components, radii. A round is one narrow pass: a task returns a row a cluster
with sums, number, radius and squared distances, which are added up by cluster. The members' clusters are not stored
after every round but found again by the balls of the rounds since they were last written to the shared folder, which
happens every `every` rounds.

Defined results: vectors with another number of components, or with a null, NaN or infinite one, are left out; repeated
rows are vectors of their own; null ids are clustered, but come last among the starting vectors; of equal hashes
the vector that is smaller component by component comes first; with fewer vectors than clusters there are as many
clusters as vectors; no vectors give no rows; empty clusters keep their centroid; other columns are left out. A scaled
component beyond 2^26 raises an error, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED, EVERY = 40, 5, 256, 64, 2, 8
LARGEST = 1 << 26
#: Below this, squared distances of up to 512 components are exact as doubles.
EXACT = 1 << 21


@dataclass
class Balls:
    """The centroids of a round, and the neighbours of each by distance: numbers and squared distances."""

    centroids: np.ndarray
    neighbours: list[tuple[np.ndarray, np.ndarray]]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (as `matrix` gives them) to one vector."""
    if x.dtype == np.float64 and np.abs(c).max() < EXACT:
        d = x - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = x.astype(np.int64) - c
    return (d * d).sum(axis=1)


def root_above(n: int) -> int:
    return math.isqrt(n) + (math.isqrt(n) ** 2 < n)


def balls(centroids: np.ndarray, radii: list[int]) -> Balls:
    """radii: a bound of each ball's radius, in whole numbers; -1 for a cluster without members."""
    neighbours = []
    for i, c in enumerate(centroids):
        d = squared(centroids, c)
        near = np.flatnonzero(d <= 4 * min(max(radii[i], 0), 1 << 30) ** 2) if radii[i] >= 0 else np.zeros(0, np.int64)
        near = near[near != i]
        near = near[np.lexsort((near, d[near]))]
        neighbours.append((near, d[near]))
    return Balls(centroids, neighbours)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The first nearest centroid of each row, by comparing all."""
    best, out = squared(x, centroids[0]), np.zeros(len(x), np.int32)
    for i in range(1, len(centroids)):
        d = squared(x, centroids[i])
        closer = d < best
        best[closer], out[closer] = d[closer], i
    return out


def move(x: np.ndarray, cluster: np.ndarray, model: Balls) -> np.ndarray:
    """The nearest centroid of each row, from its ball: the core stays, the annuli are compared with relevant neighbours."""
    out = cluster.copy()
    for c in np.unique(cluster).tolist():
        rows = np.flatnonzero(cluster == c)
        near, apart = model.neighbours[c]
        own = squared(x[rows], model.centroids[c])
        relevant = np.searchsorted(apart, 4 * own, side="right")
        moving = np.argsort(-relevant, kind="stable")[: np.count_nonzero(relevant)]  # farthest annuli first
        if not len(moving):
            continue
        members, best, number = x[rows[moving]], own[moving], np.full(len(moving), c, np.int32)
        reach = relevant[moving]
        for i in range(int(reach[0])):
            some = np.searchsorted(-reach, -i, side="left")  # rows with more than i relevant neighbours
            d = squared(members[:some], model.centroids[near[i]])
            closer = (d < best[:some]) | ((d == best[:some]) & (near[i] < number[:some]))
            best[:some][closer], number[:some][closer] = d[closer], near[i]
        out[rows[moving]] = number
    return out


def scaled(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and x, the whole numbers, of the vectors that count."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    large = F.exists(v, lambda e: F.abs(e) * scale >= LARGEST)
    whole = F.when(large, F.raise_error(F.lit("a component is too large for exact squared distances"))).otherwise(F.transform(v, lambda e: F.floor(e * scale).cast("int")))
    kept = vectors.where((F.size(v) == dimensions) & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.cast("array<int>").alias("x"))


def start(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    named = rows.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    first = named.orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r.x for r in first], np.int64)


def matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """The batch's vectors, as doubles where all computation on them is exact, else as whole numbers."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    small = dimensions <= 512 and max(-int(x.min(initial=0)), int(x.max(initial=0))) < EXACT
    return x.astype(np.float64 if small else np.int64)


def _assign(x: np.ndarray, cluster: np.ndarray | None, models: list[Balls]) -> np.ndarray:
    for i, model in enumerate(models):
        cluster = nearest(x, model.centroids) if cluster is None and i == 0 else move(x, cluster, model)
    return cluster


def _members(batch: pa.RecordBatch) -> np.ndarray | None:
    return batch.column("cluster").to_numpy(zero_copy_only=False) if "cluster" in batch.schema.names else None


def _totals(rows: DataFrame, models: list[Balls], dimensions: int) -> list:
    """By cluster: sums of components, number, largest and summed squared distance of the members; all clusters' rows, which are
    as many as the model's, on the driver."""
    k = len(models[-1].centroids)
    names = [f"s{i}" for i in range(dimensions)]

    def run(batches):
        sums, n, far, total = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, dimensions)
            cluster = _assign(x, _members(batch), models)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                d = squared(own, models[-1].centroids[c])
                sums[c] += own.sum(axis=0).astype(np.int64)
                n[c] += len(own)
                far[c] = max(far[c], d.max())
                total[c] += d.sum()
        has = np.flatnonzero(n)
        columns = [has.astype(np.int32), n[has], far[has], total[has], *[sums[has, i] for i in range(dimensions)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "n", "far", "total", *names])

    parts = rows.mapInArrow(run, ", ".join(["cluster int, n long, far long, total long", *[f"{s} long" for s in names]]))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("total").alias("total"), F.array(*[F.sum(s) for s in names]).alias("sums")).collect()


def _assigned(rows: DataFrame, models: list[Balls], dimensions: int, schema: str, columns) -> DataFrame:
    """The rows under the models, with what `columns` makes of a batch, its components and clusters."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, dimensions)
                yield columns(batch, x, _assign(x, _members(batch), models))

    return rows.mapInArrow(run, schema)


def ball_kmeans(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED, every: int = EVERY,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector."""
    rows = scaled(vectors, id_col, vector_col, dimensions, scale)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start(rows, clusters, seed)
    k = len(centroids)
    if not k:
        return vectors.sparkSession.createDataFrame([], out)
    models = [balls(centroids, [-1] * k)]  # of the rounds since the members' clusters were last written
    for done in range(1, rounds + 1):
        radii, moved = [-1] * k, centroids.copy()
        for r in _totals(rows, models, dimensions):
            moved[r.cluster] = [s // r.n for s in r.sums]
            radii[r.cluster] = root_above(r.far) + root_above(int(squared(moved[r.cluster][None], centroids[r.cluster])[0]))
        centroids = moved
        if len(models) == every and done < rounds:
            with_cluster = lambda b, x, c: pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(c)], names=["vec_id", "x", "cluster"])
            rows = checkpoint(_assigned(rows, models, dimensions, "vec_id long, x array<int>, cluster int", with_cluster))
            models = []
        models.append(balls(centroids, radii))
    inertia = {r.cluster: r.total for r in _totals(rows, models, dimensions)}
    own = np.array([inertia.get(c, 0) for c in range(k)], np.int64)
    total = int(sum(inertia.values()))
    sha = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def columns(batch, x, cluster):
        distance = np.zeros(len(x), np.int64)
        for c in np.unique(cluster).tolist():
            distance[cluster == c] = squared(x[cluster == c], centroids[c])
        arrays = [cluster, distance, own[cluster], np.full(len(x), total, np.int64), sha[cluster]]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), *map(pa.array, arrays)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return _assigned(rows, models, dimensions, out, columns)
