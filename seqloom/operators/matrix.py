"""Feature matrices, z-scores, covariance, principal components and k-means.

Rows stay distributed as arrays; the driver holds sums, covariances and centroids only."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import damage as dm
from seqloom.operators.kmers import DENSE, frequency_matrix, frequency_rows, gc_array, names, pieces
from seqloom.storage import checkpoint

FEATURES18 = ["gc", *[f"freq_{n}" for n in names(2)], "norm_length"]


def features18(reads: DataFrame) -> DataFrame:
    """read_idx and x: GC, the 16 dinucleotide frequencies and the normalised length."""

    def run(frames):
        for f in frames:
            if len(f):
                seqs = f["seq"].tolist()
                length = np.array([len(s) for s in seqs], np.float64)
                norm = np.where(length > 0, np.log2(np.maximum(length, 1)) / 12, 0.0)
                x = np.column_stack([gc_array(seqs), frequency_matrix(seqs, 2), norm])
                yield pd.DataFrame({"read_idx": f["read_idx"], "x": list(x)})

    return reads.select("read_idx", "seq").mapInPandas(run, "read_idx long, x array<double>")


def codon_matrix(seqs: list[str]) -> np.ndarray:
    place = {c: i for i, c in enumerate(names(3))}
    out = np.zeros((len(seqs), 64))
    for i, s in enumerate(seqs):
        for j in range(0, len(s) - 2, 3):
            if (at := place.get(s[j : j + 3])) is not None:
                out[i, at] += 1
        if len(s) >= 3:
            out[i] /= len(s) // 3
    return out


def legacy_width(k: int, use_codon: bool) -> int:
    return 4**k + (64 if use_codon else 0) + DAMAGE_FEATURES


DAMAGE_FEATURES = 12


def _damage_features(f: pd.DataFrame, window: int) -> np.ndarray:
    """GC and eleven damage features. Reads that took the fast path have their change points and decay model computed on
    `window` bases; `support` is the mate evidence, if any."""
    seqs = f["seq"].tolist()
    length = np.array([len(s) for s in seqs], np.int64)
    got = dm.assess(seqs, window)
    n = np.minimum(window, length)
    (c5, _), (c3, _) = dm.segments(seqs, n, 5), dm.segments(seqs, n, 3)
    again = dm.decay_model(seqs, n)
    own = lambda a, b: np.where(np.isnan(got[a]), b, got[a])
    p5, p3 = own("pvalue5", dm.change_arrays(c5, n, dm.T)[2]), own("pvalue3", dm.change_arrays(c3, n, dm.A)[2])
    ratio = np.where(got["damage3"] > 0, got["damage5"] / np.where(got["damage3"] > 0, got["damage3"], 1), 1.0)
    llr = own("fit_excess", again["llr"])
    return np.column_stack([gc_array(seqs), got["damage5"], got["damage3"], got["combined"], 1 - np.minimum(p5, p3), own("fit5", again["fit5"]), own("fit3", again["fit3"]), np.clip(ratio, 0.33, 3.0), own("lambda5", again["lambda5"]), own("lambda3", again["lambda3"]), f["support"].to_numpy(), (np.clip(llr, -5, 5) + 5) / 10])


def legacy_features(reads: DataFrame, k: int = 4, use_codon: bool = False, window: int = 5) -> DataFrame:
    """read_idx and x: k-mer frequencies, codon usage if asked for, and twelve damage features. From k = 6 on a read has the
    places i of its features and their values v in place of x; other features are 0."""
    support = F.coalesce(F.col("support"), F.lit(0.5)) if "support" in reads.columns else F.lit(0.5)
    sparse = 4**k > DENSE

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            seqs = f["seq"].tolist()
            rest = np.column_stack([*([codon_matrix(seqs)] if use_codon else []), _damage_features(f, window)])
            if not sparse:
                yield pa.RecordBatch.from_arrays([pa.array(f["read_idx"]), lists(np.column_stack([frequency_matrix(seqs, k), rest]))], names=["read_idx", "x"])
                continue
            owner, index, freq = frequency_rows(seqs, k)
            more, column = np.nonzero(rest)
            owner, index, value = np.concatenate([owner, more]), np.concatenate([index, 4**k + column]), np.concatenate([freq, rest[more, column]])
            order = np.lexsort((index, owner))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(seqs)))]).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (index.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([pa.array(f["read_idx"]), *arrays], names=["read_idx", "i", "v"])

    def framed(batches):
        for batch in batches:
            for a, b in pieces(batch.column("seq").to_pylist()):
                yield from run([batch.slice(a, b - a).to_pandas()])

    return reads.select("read_idx", "seq", support.cast("double").alias("support")).mapInArrow(framed, "read_idx long, " + ("i array<int>, v array<double>" if sparse else "x array<double>"))


def dense(batch: pa.RecordBatch) -> np.ndarray:
    """The `x` of a batch as rows by columns, without a copy of each row."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def lists(x: np.ndarray) -> pa.ListArray:
    x = np.ascontiguousarray(x, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


#: Partial moments are merged by this number of tasks before the driver takes what is left.
MERGERS = 16


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix (sum of outer products about the mean), exact in one pass: parts are combined by
    their means, so no precision is lost to large sums."""

    def joined(n, mean, scatter, b, m, s):
        if not n:
            return b, m, s
        delta = m - mean
        return n + b, mean + delta * b / (n + b), scatter + s + np.outer(delta, delta) * n * b / (n + b)

    def row(n, mean, scatter):
        return pa.RecordBatch.from_arrays([pa.array([n]), lists(mean[None, :]), lists(scatter.reshape(1, -1))], names=["n", "mean", "scatter"])

    def run(batches):
        n, mean, scatter = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = dense(batch)
                m = x.mean(axis=0)
                n, mean, scatter = joined(n, mean, scatter, len(x), m, (x - m).T @ (x - m))
        if n:
            yield row(n, mean, scatter)

    def merge(batches):
        n, mean, scatter = 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                m = np.array(r["mean"])
                n, mean, scatter = joined(n, mean, scatter, r["n"], m, np.array(r["scatter"]).reshape(len(m), len(m)))
        if n:
            yield row(n, mean, scatter)

    schema = "n long, mean array<double>, scatter array<double>"
    parts = rows.select("x").mapInArrow(run, schema)
    merged = parts.withColumn("merger", F.spark_partition_id() % MERGERS).repartition(MERGERS, "merger").drop("merger").mapInArrow(merge, schema)
    n, mean, scatter = 0, np.zeros(0), np.zeros((0, 0))
    for r in sorted(merged.collect(), key=lambda r: (r.n, r.mean)):  # at most MERGERS rows
        m = np.array(r.mean)
        n, mean, scatter = joined(n, mean, scatter, r.n, m, np.array(r.scatter).reshape(len(m), len(m)))
    return n, mean, scatter


def _applied(rows: DataFrame, f) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("read_idx"), lists(f(dense(batch)))], names=["read_idx", "x"])

    return rows.select("read_idx", "x").mapInArrow(run, "read_idx long, x array<double>")


def scaling(n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What z-scores subtract and divide by: columns that hardly vary stay as they are."""
    std = np.sqrt(np.diag(scatter) / max(n, 1))
    varies = std > 1e-10
    return np.where(varies, mean, 0.0), np.where(varies, std, 1.0)


def z_scores(rows: DataFrame) -> DataFrame:
    """Each column less its mean, over its population deviation; columns that hardly vary stay as they are."""
    n, mean, scatter = moments(rows)
    if not n:
        return rows
    shift, scale = scaling(n, mean, scatter)
    return _applied(rows, lambda x: (x - shift) / scale)


def covariance(rows: DataFrame) -> np.ndarray:
    n, _, scatter = moments(rows)
    return scatter / max(n - 1, 1)


def principal_components(rows: DataFrame, components: int, scaled: bool = False, width: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The projected rows, the retained eigenvalues, and all of them; of the rows' z-scores with `scaled`, whose moments
    follow from the rows' own. The largest loading of a component is positive. With no more features than components, or
    fewer than two rows, the rows (or z-scores) come back as they are. With `width` above `WIDE`, or rows as places and
    values, see `wide_components`."""
    if width is not None and (width > WIDE or "v" in rows.columns):
        return wide_components(rows, components, width, scaled)
    n, mean, scatter = moments(rows)
    shift, scale = scaling(n, mean, scatter) if scaled else (np.zeros_like(mean), np.ones_like(mean))
    if n < 2 or len(mean) <= components:
        return _applied(rows, lambda x: (x - shift) / scale) if scaled else rows, np.zeros(0), np.zeros(0)
    values, vectors = np.linalg.eigh(scatter / np.outer(scale, scale) / (n - 1))
    values, vectors = values[::-1], signed(vectors[:, ::-1][:, :components])
    return _applied(rows, lambda x: ((x - mean) / scale) @ vectors), values[:components], values


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)


#: Columns up to which a task holds their products with each other.
WIDE = 1_200
#: Rows of a panel that travel together, passes over the rows, and the share of the first eigenvalue by which none may change.
PANEL, PASSES, TOLERANCE = 4_096, 40, 1e-10


class Rows:
    """A batch of rows, dense (x) or as places and values (i, v), for products with panels of width by few numbers."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.width, self.n = width, batch.num_rows
        self.x = dense(batch) if "x" in batch.schema.names else None
        if self.x is None:
            size = batch.column("i").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            self.owner = np.repeat(np.arange(self.n), size)
            self.index, self.value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "v"))

    def times(self, panel: np.ndarray) -> np.ndarray:
        if self.x is not None:
            return self.x @ panel
        return np.stack([np.bincount(self.owner, self.value * p[self.index], self.n) for p in panel.T], axis=1)

    def back(self, y: np.ndarray) -> np.ndarray:
        """The transposed rows times y."""
        if self.x is not None:
            return self.x.T @ y
        return np.stack([np.bincount(self.index, self.value * c[self.owner], self.width) for c in y.T], axis=1)

    def squares(self) -> np.ndarray:
        return (self.x**2).sum(axis=0) if self.x is not None else np.bincount(self.index, self.value**2, self.width)


def _panel_sum(rows: DataFrame, width: int, columns: int, of_batch) -> np.ndarray:
    """The sum over batches of panels (width by columns); tasks return them in blocks of rows, which are added up by block."""

    def run(batches):
        total = np.zeros((width, columns))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                total += of_batch(Rows(batch.slice(at, 2048), width))
        for at in range(0, width, PANEL):
            yield pa.RecordBatch.from_arrays([pa.array([at // PANEL], pa.int32()), lists(total[at : at + PANEL].reshape(1, -1))], names=["block", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
                own = sums.values.to_numpy(zero_copy_only=False)
                held[block] = held[block] + own if block in held else own
        for block, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), lists(sums[None, :])], names=["block", "sums"])

    schema = "block int, sums array<double>"
    parts = rows.select([c for c in ("x", "i", "v") if c in rows.columns]).mapInArrow(run, schema)
    merged = parts.withColumn("merger", F.spark_partition_id() % MERGERS).repartition("block", "merger").drop("merger").mapInArrow(add, schema)
    out = np.zeros((width, columns))
    for r in sorted(merged.collect()):  # the panel, at most MERGERS times
        at = r.block * PANEL
        out[at : at + PANEL] += np.array(r.sums).reshape(-1, columns)
    return out


def wide_components(rows: DataFrame, components: int, width: int, scaled: bool = False, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """`principal_components` of many columns, without their products with each other: a random panel of some more columns than
    components is multiplied with the covariance, pass by pass, until its eigenvalues stay (Rayleigh-Ritz). A pass and
    the driver hold width by few numbers. Of all eigenvalues only the retained ones are known; the others stand as
    the mean of what is left of the variance."""
    rows = checkpoint(rows)
    n = rows.count()
    first = _panel_sum(rows, width, 2, lambda b: np.stack([b.back(np.ones((b.n, 1)))[:, 0], b.squares()], axis=1))
    mean = first[:, 0] / max(n, 1)
    scatter = np.maximum(first[:, 1] - n * mean**2, 0.0)
    shift, scale = np.zeros(width), np.ones(width)
    if scaled:
        std = np.sqrt(scatter / max(n, 1))
        scale = np.where(std > 1e-10, std, 1.0)
        shift = np.where(std > 1e-10, mean, 0.0)
    project = lambda vectors, less: _mapped_rows(rows, width, vectors / scale[:, None], less)
    if n < 2 or width <= components:
        eye = np.eye(width)
        return project(eye, shift / scale), np.zeros(0), np.zeros(0)
    size = min(width, max(2 * components, components + 10))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    before = None
    for _ in range(PASSES):
        panel = q / scale[:, None]
        less = mean @ panel

        def of_batch(b, panel=panel, less=less):
            y = b.times(panel) - less
            return b.back(y) - np.outer(mean, y.sum(axis=0))

        z = _panel_sum(rows, width, size, of_batch) / scale[:, None] / (n - 1)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, vectors = values[::-1][:components], (q @ turn)[:, ::-1][:, :components]
        if size == width or before is not None and np.abs(values - before).max() <= TOLERANCE * max(values[0], 1e-300):
            break
        before, q = values, np.linalg.qr(z)[0]
    vectors = signed(vectors)
    rest = max(float((scatter / scale**2).sum()) / (n - 1) - float(values.sum()), 0.0)
    every = np.concatenate([values, np.full(width - components, rest / (width - components))])
    return project(vectors, mean @ (vectors / scale[:, None])), values, every


def _mapped_rows(rows: DataFrame, width: int, panel: np.ndarray, less: np.ndarray) -> DataFrame:
    """read_idx and x: the rows times a panel, less a row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column("read_idx"), lists(Rows(part, width).times(panel) - less)], names=["read_idx", "x"])

    return rows.select([c for c in ("read_idx", "x", "i", "v") if c in rows.columns]).mapInArrow(run, "read_idx long, x array<double>")


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _draws(rows: DataFrame, known: np.ndarray, number: int, seed: int, turn: int) -> np.ndarray:
    """Rows drawn with a chance in proportion to their squared distance from the nearest known centroid: those with the
    least -ln(u) / weight, u from a hash of row and seed; `number` rows to the driver."""

    def run(batches):
        for f in batches:
            if f.num_rows:
                w = distances(dense(f), known).min(axis=1) if len(known) else np.ones(f.num_rows)
                u = (f.column("h").to_numpy() % (2**52) + 0.5) / 2**52
                keys = np.where(w > 0, -np.log(u) / np.where(w > 0, w, 1), np.inf)
                least = np.lexsort((f.column("read_idx").to_numpy(), keys))[:number]
                least = pa.array(least[np.isfinite(keys[least])])  # the batch's own draws
                yield pa.RecordBatch.from_arrays([pa.array(keys).take(least), f.column("read_idx").take(least), f.column("x").take(least)], names=["key", "read_idx", "x"])

    hashed = rows.select("read_idx", "x", F.abs(F.shiftright(F.xxhash64("read_idx", F.lit(seed), F.lit(turn)), 1)).alias("h"))
    got = hashed.mapInArrow(run, "key double, read_idx long, x array<double>").orderBy("key", "read_idx").limit(number).collect()
    return np.array([r.x for r in got])


#: Passes that draw candidates, and candidates of a pass for each centroid wanted.
SEED_PASSES, SEED_FACTOR = 3, 4


def seed_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++ on candidates: the first row uniformly, then a few passes that each draw `SEED_FACTOR` x k rows by their
    squared distance; a last pass weighs the candidates by the rows nearest to them, and k-means++ on the driver picks k
    of them."""
    found = _draws(rows, np.zeros((0, 0)), 1, seed, 0)
    for turn in range(1, SEED_PASSES + 1):
        more = _draws(rows, found, SEED_FACTOR * k, seed, turn)
        if not len(more):
            break
        found = np.concatenate([found, more])
    found = np.unique(found, axis=0)
    if len(found) <= k:
        return found
    _, weight = lloyd_step(rows, found)
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < k:
        far = distances(found, found[chosen]).min(axis=1) * weight
        if not far.any():
            break
        chosen.append(int(rng.choice(len(found), p=far / far.sum())))
    return found[chosen]


#: Up to this number of tasks the driver adds up their sums (a row a task and cluster), which saves a shuffle a round.
DIRECT = 128


def lloyd_step(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids and sizes; an empty cluster keeps its centroid."""
    k, d = centroids.shape

    def run(batches):
        sums, sizes = np.zeros((k, d)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = dense(batch)
                mark = np.eye(k)[distances(x, centroids).argmin(axis=1)]
                sums += mark.T @ x
                sizes += mark.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), lists(sums), pa.array(sizes)], names=["cluster", "sums", "size"])

    added = rows.select("x").mapInArrow(run, "cluster int, sums array<double>, size double")
    if rows.rdd.getNumPartitions() > DIRECT:
        added = added.groupBy("cluster").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"), F.sum("size").alias("size"))
    sums, sizes = np.zeros((k, d)), np.zeros(k)
    for r in sorted(added.collect()):
        sums[r.cluster] += r.sums
        sizes[r.cluster] += r["size"]
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids), sizes


def nearest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """read_idx and cluster of the nearest centroid; the first wins ties."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("read_idx"), pa.array(distances(dense(batch), centroids).argmin(axis=1).astype("int32"))], names=["read_idx", "cluster"])

    return rows.select("read_idx", "x").mapInArrow(run, "read_idx long, cluster int")


def k_means(rows: DataFrame, k: int, seed: int = 42, max_rounds: int = 50, start: np.ndarray | None = None) -> DataFrame:
    """read_idx and cluster: k-means++ (or given centroids) and Lloyd's rounds until the centroids, and so the assignments,
    stay."""
    rows = checkpoint(rows)  # each of up to k + max_rounds passes reads it
    k = min(k, rows.count())
    if k <= 1:
        return rows.select("read_idx", F.lit(0).alias("cluster"))
    centroids = seed_centroids(rows, k, seed) if start is None else start
    for _ in range(max_rounds):
        new, _ = lloyd_step(rows, centroids)
        if np.allclose(new, centroids, rtol=0, atol=1e-12):
            break
        centroids = new
    return nearest(rows, centroids)


def two_means(rows: DataFrame, max_rounds: int = 20) -> DataFrame:
    """Split in two: the first row (by read_idx) and the row farthest from it start; ties go to the first."""
    rows = checkpoint(rows)
    first = rows.orderBy("read_idx").limit(1).collect()
    if not first:
        return rows.select("read_idx", F.lit(0).alias("cluster"))
    a = np.array([first[0].x])
    far = rows.withColumn("d", F.expr("aggregate(zip_with(x, array(" + ", ".join(f"{float(v)!r}D" for v in a[0]) + "), (p, q) -> (p - q) * (p - q)), 0D, (s, v) -> s + v)")).orderBy(F.desc("d"), "read_idx").limit(1).collect()
    centroids = np.array([first[0].x, far[0].x], np.float64)
    for _ in range(max_rounds):
        new, _ = lloyd_step(rows, centroids)
        if np.allclose(new, centroids, rtol=0, atol=1e-12):
            break
        centroids = new
    return nearest(rows, centroids)
