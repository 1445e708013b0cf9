"""Hard EM over k-mer profiles with merging by BIC.

A round writes one narrow table: each read with its cluster, the likelihood of its best cluster, and a bound of that of all
others. Between rounds the profiles drift; a read of n k-mers gains or loses at most n times the drift of a logarithm. A
read whose best cluster still lies above the bound of the others keeps it and is not looked at again; only the others
are counted and compared. The clusters' sums change by the reads that moved, so that each task returns sums of those,
clusters x (4^k + 2) numbers at most. Merging and convergence need no more than the sums.

The table and the model of each round lie in the shared folder. With a folder of its own, an interrupted run goes on from the
last round that it wrote; else the tables are removed after use."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import storage
from seqloom.operators import profiles as pf
from seqloom.operators.kmers import Counts, gc_array, pieces
from seqloom.operators.matrix import lists

MIN_ROUNDS = 5
#: Likelihoods are compared to six decimals; a bound has to hold by more.
SLACK = 1e-5
NAMES = ["cluster", "sums", "size", "gc", "moved"]
#: Tasks that add up the other tasks' sums, and bytes of a piece of a saved array.
MERGERS, PIECE = 8, 8 << 20


@dataclass
class Model:
    profiles: np.ndarray  # clusters by k-mers
    sizes: np.ndarray
    gc: np.ndarray
    k: int
    history: list[float] = field(default_factory=list)
    last: Model | None = None  # the profiles that gave the last assignment,
    relabel: np.ndarray | None = None  # and what its clusters became when they were merged

    def assign(self, seqs: list[str], relabel: np.ndarray | None = None) -> np.ndarray:
        """The best cluster of each read; the lowest number wins ties, so a read without k-mers goes to cluster 0."""
        log_p, out = np.log(self.profiles), np.zeros(len(seqs), np.int64)
        for a, b in pieces(seqs):
            out[a:b] = best_two(Counts(seqs[a:b], self.k).times(log_p))[0]
        return out if relabel is None else relabel[out]


def best_two(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best cluster of each row, its likelihood, and the best of the others (-inf without others)."""
    best, rows = np.round(ll, 6).argmax(axis=1), np.arange(len(ll))
    top = ll[rows, best]
    if ll.shape[1] == 1:
        return best, top, np.full(len(ll), -np.inf)
    rest = ll.copy()
    rest[rows, best] = -np.inf
    return best, top, rest.max(axis=1)


def _sums(reads: DataFrame, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """k-mer sums, sizes and GC sums by cluster: of the reads' clusters `new`, less those of their clusters `old` (below 0:
    none); and how many reads had an old one."""
    width = 4**k

    def run(batches):
        sums, sizes, gc, left = np.zeros((n, width)), np.zeros(n), np.zeros(n), np.zeros(n)
        for batch in batches:
            seqs, old, new = batch.column("seq").to_pylist(), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("old", "new"))
            for a, b in pieces(seqs):
                counts, share = Counts(seqs[a:b], k), gc_array(seqs[a:b])
                for cluster, sign in ((old[a:b], -1.0), (new[a:b], 1.0)):
                    counts.add_to(sums, cluster, sign)
                    own = cluster >= 0
                    sizes += sign * np.bincount(cluster[own], minlength=n)
                    gc += sign * np.bincount(cluster[own], share[own], n)
                left += np.bincount(old[old >= 0], minlength=n)
        has = np.flatnonzero(sums.any(axis=1) | (sizes != 0) | (gc != 0) | (left != 0))
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), lists(sums[has]), pa.array(sizes[has]), pa.array(gc[has]), pa.array(left[has])], names=NAMES)

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i, (c, *rest) in enumerate(zip(*[batch.column(x).to_pylist() for x in ("cluster", "size", "gc", "moved")])):
                own = held.setdefault(c, [np.zeros(width), np.zeros(3)])
                own[0] += sums[i]
                own[1] += rest
        for c, (sums, rest) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), lists(sums[None, :]), *(pa.array([x]) for x in rest)], names=NAMES)

    schema = "cluster int, sums array<double>, size double, gc double, moved double"
    # Tasks' sums meet in a fixed number of tasks first, whatever their number, and then by cluster.
    parts = reads.select("seq", "old", "new").mapInArrow(run, schema)
    merged = parts.withColumn("merger", F.spark_partition_id() % MERGERS).repartition(MERGERS, "merger").drop("merger").mapInArrow(add, schema)
    sums, sizes, gc, changed = np.zeros((n, width)), np.zeros(n), np.zeros(n), 0
    for r in sorted(merged.collect(), key=lambda r: (r.cluster, r["size"], r.gc)):  # at most MERGERS rows a cluster
        sums[r.cluster] += r.sums
        sizes[r.cluster] += r["size"]
        gc[r.cluster] += r.gc
        changed += int(r.moved)
    return sums, sizes, gc, changed


def initialise(reads: DataFrame, k: int = 4, min_cluster_size: int = 10, pseudocount: float = pf.PSEUDOCOUNT) -> tuple[Model, DataFrame, tuple]:
    """Profiles from the confident reads of reads with a `cluster` column, those reads with `start`, the new number of
    their cluster (-1: none), and the sums. Without a large enough cluster every read starts in cluster 0."""
    kept = pf.initial_clusters(reads, min_cluster_size).select("old", "cluster").collect()
    if not kept:
        started = reads.withColumn("start", F.lit(0))
        n = 1
    else:
        number = F.create_map(*[F.lit(x) for r in kept for x in (r.old, r.cluster)])
        started = reads.withColumn("start", F.coalesce(F.try_element_at(number, F.col("cluster")), F.lit(-1)))
        n = len(kept)
    sums, sizes, gc, _ = _sums(started.select("seq", F.lit(-1).alias("old"), F.col("start").alias("new")), k, n)
    return Model(pf.smooth(sums, pseudocount), sizes, np.where(sizes > 0, gc / np.maximum(sizes, 1), 0.0), k), started, (sums, sizes, gc)


STATE = "seq string, new int, old int, best double, rest double, seen boolean"


def _round(frame: DataFrame, now: Model, last: Model | None, relabel: np.ndarray) -> DataFrame:
    """The reads with their new clusters, those before, the best likelihood, a bound of the others, and whether they had to be
    compared. In the first round (no `last`) `new` is the start, and every read is compared."""
    log_p = np.log(now.profiles)
    if last is not None:
        before = np.log(last.profiles)
        alive = np.flatnonzero(relabel >= 0)
        drift = log_p[relabel[alive]] - before[alive]
        down = np.zeros(len(before))
        down[alive] = np.minimum(drift.min(axis=1), 0)
        up = max(float(drift.max()), 0.0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seqs = batch.column("seq").to_pylist()
            was = batch.column("new").to_numpy(zero_copy_only=False)
            if last is None:
                old, best, rest, look = was, np.zeros(len(was)), np.zeros(len(was)), np.ones(len(was), bool)
            else:
                old = relabel[was].astype(np.int32)
                most = np.maximum(np.array([len(s) for s in seqs]) - now.k + 1, 0)  # k-mers at most
                best = batch.column("best").to_numpy(zero_copy_only=False) + most * down[was]
                rest = batch.column("rest").to_numpy(zero_copy_only=False) + most * up
                look = best - rest <= SLACK
            new = old.copy()
            best, rest = best.copy(), rest.copy()
            at = np.flatnonzero(look)
            own = [seqs[i] for i in at.tolist()]
            for a, b in pieces(own):
                new[at[a:b]], best[at[a:b]], rest[at[a:b]] = best_two(Counts(own[a:b], now.k).times(log_p))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), *map(pa.array, (new.astype(np.int32), old.astype(np.int32), best, rest, look))], names=["seq", "new", "old", "best", "rest", "seen"])

    columns = ["seq", "new"] if last is None else ["seq", "new", "best", "rest"]
    return frame.select(*columns).mapInArrow(run, STATE)


def _save(spark: SparkSession, path: str, values: dict) -> None:
    """Arrays and plain values as rows of pieces."""
    rows = []
    for name, value in values.items():
        out = io.BytesIO()
        np.save(out, np.array(json.dumps(value)) if not isinstance(value, np.ndarray) else value, allow_pickle=False)
        data = out.getvalue()
        rows += [(name, i, bytearray(data[i : i + PIECE])) for i in range(0, len(data), PIECE)]
    spark.createDataFrame(rows, "name string, at long, data binary").write.mode("overwrite").parquet(path)


def _load(spark: SparkSession, path: str) -> dict:
    parts: dict[str, list] = {}
    for r in spark.read.parquet(path).collect():
        parts.setdefault(r.name, []).append((r.at, bytes(r.data)))
    out = {n: np.load(io.BytesIO(b"".join(d for _, d in sorted(p))), allow_pickle=False) for n, p in parts.items()}
    return {n: json.loads(str(v)) if v.dtype.kind == "U" else v for n, v in out.items()}


def em(
    reads: DataFrame, k: int = 4, min_cluster_size: int = 10, max_rounds: int = 20, convergence: float = 0.001, pseudocount: float = pf.PSEUDOCOUNT,
    folder: str | None = None, merge: bool = True,
) -> Model:
    """Fits profiles to reads (seq, cluster). Each round assigns, sums, drops empty clusters, merges while the BIC falls,
    and ends from the fifth round without a merge if no read moved or the likelihood hardly changed. `folder` is a place in
    the shared folder for the rounds' tables: a run that finds some there goes on after the last. Without `merge` no clusters
    are joined."""
    spark = reads.sparkSession
    own = folder or storage.new_folder(spark)
    table = lambda round_: f"{own}/reads-{round_}"
    saved = lambda round_: f"{own}/model-{round_}"
    done = next((r for r in range(max_rounds, -1, -1) if folder and storage.is_written(spark, saved(r))), -1)
    if done < 0:
        model, started, (sums, sizes, gc) = initialise(reads, k, min_cluster_size, pseudocount)
        last, relabel, ended = None, np.arange(len(model.sizes)), False
        frame = storage.written(started.select("seq", F.col("start").cast("int").alias("new")), table(0))
        done = 0
    else:
        v = _load(spark, saved(done))
        sums, sizes, gc, relabel, ended = v["sums"], v["sizes"], v["gc"], v["relabel"], v["ended"]
        model = Model(pf.smooth(sums, pseudocount), sizes, gc / np.maximum(sizes, 1), k, v["history"])
        last, frame = Model(v["last"], sizes, gc, k), spark.read.schema(STATE).parquet(table(done))
    while done < max_rounds and not ended:
        done += 1
        at = len(model.profiles)
        frame = storage.written(_round(frame, model, last, relabel), table(done))
        *more, changed = _sums(frame.where("new <> old"), k, at)  # at first, reads outside every cluster do not count as changed
        sums, sizes, gc = (x + y for x, y in zip((sums, sizes, gc), more))
        alive = np.flatnonzero(sizes > 0)
        number = np.full(at, -1)
        number[alive] = np.arange(len(alive))
        merges, merged = pf.Merges(sums[alive], sizes[alive], gc[alive], pseudocount), False
        while merge and merges.step(int(sizes.sum())) is not None:
            merged = True
        sums, sizes, gc, into = merges.left()
        relabel = np.where(number >= 0, into[np.maximum(number, 0)], -1)
        last = model
        model = Model(pf.smooth(sums, pseudocount), sizes, gc / np.maximum(sizes, 1), k, [*last.history])
        model.history.append(float((sums * np.log(model.profiles)).sum()))
        ended = done >= MIN_ROUNDS and not merged and (changed == 0 or relative_change(model.history) < convergence)
        if folder:
            _save(spark, saved(done), {"sums": sums, "sizes": sizes, "gc": gc, "relabel": relabel, "last": last.profiles, "history": model.history, "ended": bool(ended)})
        storage.remove(spark, table(done - 1))  # the new table does not depend on it
    # The clusters of the last round are `last`'s assignment, relabelled.
    model.last, model.relabel = last, relabel
    if not folder:
        storage.remove(spark, own)
    return model


def relative_change(history: list[float]) -> float:
    """How far the last likelihood is from the one before, over the last one."""
    change = abs(history[-1] - history[-2])
    return change / abs(history[-1]) if abs(history[-1]) > 1e-10 else change


def assignments(reads: DataFrame, model: Model) -> DataFrame:
    """read_idx and cluster of every read under the fitted model."""
    last, relabel = model.last or model, model.relabel

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"read_idx": f["read_idx"], "cluster": last.assign(f["seq"].tolist(), relabel).astype("int32")})

    return reads.select("read_idx", "seq").mapInPandas(run, "read_idx long, cluster int")


def map_reads(reads: DataFrame, model: Model | None) -> DataFrame:
    """read_idx and cluster of reads under the final profiles of contigs; -1 without profiles."""
    if model is None or not len(model.profiles):
        return reads.select("read_idx", F.lit(-1).alias("cluster"))
    return assignments(reads, Model(model.profiles, model.sizes, model.gc, model.k))
