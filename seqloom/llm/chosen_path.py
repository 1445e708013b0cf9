"""Similarity join on word shingles by chosen paths.

Documents with the same set of five-word shingles are one node. Each node's set is embedded as 128 minima, one for each
coordinate; a token is a coordinate with its minimum. A run samples one token at the root and then, at each node of the
tree, tokens whose hash with the path lies under a bound, so that similar sets go on to the same buckets; runs repeat
until pairs at the threshold are met with the target recall. Buckets are streamed: members are compared by sketch with
the bucket's pivots, a member near a pivot is absorbed, another becomes a pivot, and when a bucket has too many pivots
the remaining members are split on further sampled tokens. As Jaccard distance is a metric, a pair at the threshold of
which one member is absorbed is still joined through the pivot at the wider sketch thresholds used here.

Sketches only group nodes. All pairs within such a group are then compared exactly, in blocks, on their whole shingle
sets; links, counts and classes come from that.

Buckets are range-partitioned by path and node, so a bucket of any size spreads over tasks. The pivots of a bucket that
crosses partitions are compared in cells of two blocks. Where a partition had more than `MAX_PIVOTS` of them, or the
bucket more than `MAX_MET` in all, they are split with the members left over; members that a pivot has absorbed stay
represented by it. What is still left at `MAX_LEVELS` is compared in cells as well, so nothing is dropped.

Each further split keeps a pair at the threshold only with some chance. Nodes that were split further therefore get
more runs, as many as the target recall takes at the deepest level that a run has reached. Groups are compared block by
block; a node's set is copied to as many cells as its group has blocks.

Defined results: words are runs of characters other than space and 9-13; a text of one to four words has one shingle,
all its words; texts without words are one class; null texts are empty; null ids stay null and come after all others;
repeated rows are copies; rows with the same id and other texts are documents of their own, told apart by the hash of
the text; other columns are left out. Hashes of shingles have 64 bits.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Memo, checkpoint, map_slices, new_names
from seqloom.llm.components import components

WORDS, THRESHOLD = 5, 0.8
COORDS, FAN, RECALL = 128, 1.5, 0.999
#: Sketch shares from which a member is joined with a pivot, absorbed by it, and from which two pivots are joined.
JOIN, ABSORB, MEET = 0.60, 0.92, 0.46
#: The same for buckets that come from a split, where members near each other must not split without end.
DEEP_JOIN, DEEP_ABSORB = 0.50, 0.80
#: Two pivots that absorbed the members of a pair at the threshold may be as far apart as 0.2 from each of three steps.
DEEP_MEET = 0.36
MAX_PIVOTS, MAX_MET, MAX_LEVELS, MAX_WORDS = 512, 16_384, 8, 100_000
#: Nodes of a block of a group; groups have at most WIDE blocks until these hold more than MAX_BLOCK nodes.
BLOCK, WIDE, MAX_BLOCK = 128, 64, 1024
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EDGES = np.arange(COORDS, dtype=np.uint64) << np.uint64(57)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_J = np.arange(COORDS, dtype=np.uint64)
#: For an empty coordinate, the coordinates whose minimum it borrows, in order.
_PROBE = (mix(_J[:, None] * np.uint64(1_000_003) + np.arange(4 * COORDS, dtype=np.uint64) + np.uint64(17)) >> np.uint64(57)).astype(np.int64)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, fan: float = FAN, levels: int = 2) -> int:
    """Runs after which a pair at the threshold shares a bucket of the given level with the given probability: its root
    token is shared, and at each further level so is one of the sampled tokens, whose number is about Poisson. From the
    third level on a member may be represented by the pivot that absorbed it, which is less like the other member."""
    met = threshold
    for level in range(2, levels + 1):
        own = threshold - (0 if level == 2 else 1 - ABSORB if level == 3 else 1 - DEEP_ABSORB)
        met *= 1 - math.exp(-fan * own)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


_HASHES = Memo(xxhash.xxh64_intdigest, MAX_WORDS)


def shingle_sets(values: list[str]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    words = [WORD.findall(t) for t in values]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(_HASHES.__getitem__, w)), np.uint64, int(sizes.sum()))
    padded = np.concatenate([flat, np.zeros(WORDS, np.uint64)])
    joint = np.zeros(len(flat), np.uint64)
    for i in range(WORDS):
        joint += padded[i : len(flat) + i] * _STEP[i]
    joint = mix(joint)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WORDS:
            own = np.sort(joint[at : at + n - WORDS + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            out.append(mix((flat[at : at + n] * _STEP[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate (the top seven bits of the hashes); empty ones borrow another's."""
    if not len(own):
        return np.zeros(COORDS, np.uint64)
    at = np.searchsorted(own, _EDGES)
    low = own[np.minimum(at, len(own) - 1)]
    full = (at < len(own)) & (low >> np.uint64(57) == _J)
    if full.all():
        return low
    if not full.any():
        return np.zeros(COORDS, np.uint64)
    empty = np.flatnonzero(~full)
    hits = full[_PROBE[empty]]
    found = np.where(hits.any(axis=1), _PROBE[empty, hits.argmax(axis=1)], np.flatnonzero(full)[0])
    low[empty] = low[found]
    return low


def sketch_of(signatures: np.ndarray) -> np.ndarray:
    return (mix(signatures + _J * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def first_paths(signatures: np.ndarray, runs: int, first: int = 0) -> list[np.ndarray]:
    """The paths of two levels of each signature in `runs` runs, numbered from `first`: the run's root token, then the
    tokens sampled below it."""
    numbers = np.arange(first, first + runs)
    roots = np.argsort(mix(_J + np.uint64(99)))[numbers % COORDS]
    p1 = mix(signatures[:, roots] + roots.astype(np.uint64) * _STEP[1] + numbers.astype(np.uint64) * _STEP[2])
    bound = np.uint64(int(FAN / COORDS * 2**64))
    out: list[list[np.ndarray]] = [[] for _ in signatures]
    for r in range(runs):
        chosen = mix(p1[:, r, None] ^ (_J * _STEP[3])[None, :]) < bound
        doc, j = np.nonzero(chosen)
        paths = mix(p1[doc, r] * _STEP[0] + signatures[doc, j] + j.astype(np.uint64) * _STEP[4])
        ends = np.searchsorted(doc, np.arange(len(signatures) + 1))
        for i in range(len(signatures)):
            if ends[i] < ends[i + 1]:
                out[i].append(paths[ends[i] : ends[i + 1]])
    return [np.unique(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in out]


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), text_hash(text_col).alias("body"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def embedded(keyed: DataFrame, runs: int) -> DataFrame:
    """doc, body, node (hash of the shingle set), sketch and paths of each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("text").to_pylist())
        signatures = np.stack([signature(s) for s in sets])
        paths = first_paths(signatures, runs)
        for i, s in enumerate(sets):
            if not len(s):
                paths[i] = np.zeros(0, np.uint64)
        sketches = sketch_of(signatures)
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        arrays = [part.column("doc"), part.column("body"), pa.array(nodes, pa.binary()), pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array([p.view(np.int64) for p in paths], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "body", "node", "sketch", "paths"])

    return map_slices(keyed, lambda: run, "doc long, body long, node binary, sketch binary, paths array<long>")


def _runs(batches, key: str, others: tuple[str, ...]):
    """Groups of equal keys of a sorted partition, as pieces: key, columns, whether the piece begins and ends its group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(keys)).tolist()
        cols = [batch.column(c) for c in others]
        for a, b in zip(starts, ends):
            if held is not None:
                yield (*held, held[0] != keys[a])
            held = (keys[a], [c.slice(a, b - a) for c in cols], held is None or held[0] != keys[a])
    if held is not None:
        yield (*held, True)


def shared_paths(frontier: DataFrame) -> DataFrame:
    """The rows (path, node) whose path has at least two nodes; the first and last path of a partition stay unseen."""

    def run(batches):
        last = None  # the last row, whose path may go on in the next batch
        seen = False  # whether a row of its path has been given out
        first_path = None
        for batch in batches:
            if not batch.num_rows:
                continue
            full = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            path = full.column("path").to_numpy(zero_copy_only=False)
            if first_path is None:
                first_path = path[0]
            same = path[1:] == path[:-1]
            keep = np.zeros(len(path), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep |= path == first_path
            if last is not None and seen:
                keep[0] = True
            keep[-1] = False  # it waits
            yield full.filter(pa.array(keep))
            seen = bool(len(path) > 1 and same[-1]) or (len(path) == 1 and seen)
            last = full.slice(len(path) - 1)
        if last is not None:
            yield last

    ordered = frontier.repartitionByRange("path", "node").sortWithinPartitions("path", "node")
    return ordered.mapInArrow(run, "path long, node binary")


class Bucket:
    """The pivots of one bucket so far, and which of them are connected; its edges make a forest."""

    def __init__(self, join: float, absorb: float, most: float):
        self.join, self.absorb, self.most = join * COORDS, absorb * COORDS, most
        self.nodes: list[bytes] = []
        self.root = np.zeros(0, np.int64)
        self.sketches = np.zeros((0, COORDS), np.uint8)
        self.used = 0

    def _room(self) -> None:
        if self.used == len(self.sketches):
            grown = np.zeros((max(8, 2 * self.used), COORDS), np.uint8)
            grown[: self.used] = self.sketches[: self.used]
            self.sketches = grown
            self.root = np.concatenate([self.root, np.zeros(len(grown) - len(self.root), np.int64)])

    def add(self, nodes: list[bytes], sketches: np.ndarray, edges: list[tuple[bytes, bytes]], left: list[tuple[bytes, bytes]]) -> None:
        """Joins the members with pivots; one far from all pivots becomes a pivot or, beyond the most, is left over."""
        known = self.used
        alike = (sketches[:, None, :] == self.sketches[None, :known, :]).sum(axis=2) if known else None
        for i, node in enumerate(nodes):
            best, hits = 0, []
            if known:
                row = alike[i]
                best = int(row.max())
                if best >= self.join:
                    hits.append(np.flatnonzero(row >= self.join))
            if self.used > known:  # pivots that this piece has added
                row = (self.sketches[known : self.used] == sketches[i]).sum(axis=1)
                best = max(best, int(row.max()))
                if row.max() >= self.join:
                    hits.append(known + np.flatnonzero(row >= self.join))
            roots = np.unique(self.root[np.concatenate(hits)]) if hits else []
            if len(roots):  # the member joins one connected set of pivots, and connects others to it
                edges.append((node, self.nodes[roots[0]]))
                for r in roots[1:]:
                    edges.append((self.nodes[r], self.nodes[roots[0]]))
                    self.root[: self.used][self.root[: self.used] == r] = roots[0]
            if best >= self.absorb:
                continue
            if self.used < self.most:
                self._room()
                self.sketches[self.used] = sketches[i]
                self.root[self.used] = roots[0] if len(roots) else self.used
                self.nodes.append(node)
                self.used += 1
            else:
                left.append((node, sketches[i].tobytes()))


EDGE, PIVOT, LEFT = 0, 1, 2


def compared(members: DataFrame, join: float, absorb: float, most: float) -> DataFrame:
    """Streams buckets (path, node, sketch): kind 0 rows are edges (node, other), kind 1 rows are pivots of a bucket
    that may cross a partition's border, kind 2 rows are members to split further (other holds the sketch)."""

    def rows(kind, path, pairs):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(pairs), pa.int8()), pa.array([path] * len(pairs), pa.int64()), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["kind", "path", "node", "other"])

    def run(batches):
        edges: list[tuple[bytes, bytes]] = []
        bucket, number, border = None, 0, []
        for path, (nodes, sketches), begins, ends in _runs(batches, "path", ("node", "sketch")):
            if begins:
                bucket, number = Bucket(join, absorb, most), number + 1
            if number > 1 and begins and ends and len(nodes) == 1:
                border = [(path, bucket, nodes, sketches)]  # alone, unless it is the partition's last
                continue
            border = []
            left: list[tuple[bytes, bytes]] = []
            ids = nodes.to_pylist()
            flat = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, COORDS)
            for at in range(0, len(ids), 256):
                bucket.add(ids[at : at + 256], flat[at : at + 256], edges, left)
            if left:
                yield rows(LEFT, int(path), left)
            if ends and number == 1:
                yield rows(PIVOT, int(path), list(zip(bucket.nodes, [s.tobytes() for s in bucket.sketches[: bucket.used]])))
            if len(edges) > 20_000:
                yield rows(EDGE, 0, list(set(edges)))
                edges = []
            last = (path, bucket)
        if edges:
            yield rows(EDGE, 0, list(set(edges)))
        for path, bucket, nodes, sketches in border:
            yield rows(PIVOT, int(path), list(zip(nodes.to_pylist(), sketches.to_pylist())))
        if number > 1 and not border:
            yield rows(PIVOT, int(last[0]), list(zip(last[1].nodes, [s.tobytes() for s in last[1].sketches[: last[1].used]])))

    ordered = members.repartitionByRange("path", "node").sortWithinPartitions("path", "node")
    return ordered.mapInArrow(run, "kind tinyint, path long, node binary, other binary")


#: Tables of paths up to this number of rows (of at most 40 bytes) are broadcast.
MAX_BROADCAST_PATHS = 100_000


def _small(paths: DataFrame) -> DataFrame:
    """A checkpointed table of paths, to be broadcast if it is small, so that rows of one path need not meet in a task."""
    return F.broadcast(paths) if paths.count() <= MAX_BROADCAST_PATHS else paths


def in_cells(rows: DataFrame, meet: float) -> DataFrame:
    """Edges between all nodes (path, node, sketch) of a path that are alike by `meet`, block against block: a task holds two blocks of about
    `MAX_PIVOTS` nodes, whatever the number of nodes of a path."""

    def run(batches):
        for _, (nodes, sketches), begins, _ in _runs(batches, "cell", ("node", "sketch")):
            if begins:
                bucket = Bucket(meet, 2.0, math.inf)
            edges: list[tuple[bytes, bytes]] = []
            ids, flat = nodes.to_pylist(), np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, COORDS)
            for at in range(0, len(ids), 256):
                bucket.add(ids[at : at + 256], flat[at : at + 256], edges, [])
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["node", "other"])

    blocks = rows.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / MAX_PIVOTS).cast("int").alias("blocks"))
    placed = rows.join(_small(checkpoint(blocks)), "path").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("path", "node", "sketch", "block", other).select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "node", "sketch")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "node binary, other binary")


def crowded(out: DataFrame) -> DataFrame:
    """The paths of buckets at a partition's border that had too many pivots, in a partition or in all."""
    pivots = out.where(F.col("kind") == PIVOT)
    left = out.where(F.col("kind") == LEFT).select("path").distinct()
    many = pivots.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_MET).select("path")
    return pivots.select("path").distinct().join(left, "path", "left_semi").unionByName(many).distinct()


def split(left: DataFrame, level: int) -> DataFrame:
    """Members of buckets that are too diverse, on paths with one more sampled token."""
    bound = np.uint64(int(FAN / COORDS * 2**64))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
            row, j = np.nonzero(mix(path[:, None] ^ (_J * _STEP[3] + np.uint64(level))[None, :]) < bound)
            new = mix(path[row] * _STEP[0] + sketch[row, j] + j.astype(np.uint64) * _STEP[4])
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), part.column("node"), part.column("sketch")], names=["path", "node", "sketch"])

    return left.select("path", "node", "sketch").mapInArrow(run, "path long, node binary, sketch binary")


def walk(members: DataFrame) -> tuple[list[DataFrame], list[DataFrame], int]:
    """The edges found below the given buckets (path, node, sketch), the nodes that were split further, and the level
    reached."""
    found, again, level = [], [], 2
    while True:
        out = checkpoint(compared(members, *((JOIN, ABSORB) if level == 2 else (DEEP_JOIN, DEEP_ABSORB)), MAX_PIVOTS))
        found.append(out.where(F.col("kind") == EDGE).select("node", "other"))
        whole = _small(checkpoint(crowded(out)))
        pivots = out.where(F.col("kind") == PIVOT).select("path", "node", F.col("other").alias("sketch"))
        found.append(in_cells(pivots.join(whole, "path", "left_anti"), MEET if level == 2 else DEEP_MEET))
        left = out.where(F.col("kind") == LEFT).select("path", "node", F.col("other").alias("sketch"))
        left = checkpoint(left.unionByName(pivots.join(whole, "path", "left_semi")))
        if not left.limit(1).count():
            return found, again, level
        again.append(left.select("node"))
        if level == MAX_LEVELS:
            found.append(in_cells(left, DEEP_MEET))
            return found, again, level
        level += 1
        members = checkpoint(split(left, level))


def further_runs(nodes: DataFrame, first: int, runs: int) -> DataFrame:
    """path, node and sketch of more runs; the sketches stand for the minima."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
                paths = first_paths(sketches.astype(np.uint64), runs, first)
                part = batch.take(pa.array(np.repeat(np.arange(len(paths)), [len(p) for p in paths])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).view(np.int64)), part.column("node"), part.column("sketch")], names=["path", "node", "sketch"])

    return nodes.select("node", "sketch").mapInArrow(run, "path long, node binary, sketch binary")


def near_edges(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges (node, other) between nodes that may reach the threshold, enough to connect all that do."""
    frontier = nodes.select(F.explode("paths").alias("path"), "node")
    members = checkpoint(shared_paths(frontier).join(nodes.select("node", "sketch"), "node").select("path", "node", "sketch"))
    found, again, done, deepest = [], [], runs_for(recall, threshold), 2
    while True:
        more, nodes_again, level = walk(members)
        found, again, deepest = found + more, again + nodes_again, max(deepest, level)
        needed = runs_for(recall, threshold, levels=deepest)
        if needed <= done:
            break
        known = again[0]
        for other in again[1:]:
            known = known.unionByName(other)
        crowd = nodes.select("node", "sketch").join(known.distinct(), "node", "left_semi")
        members = checkpoint(further_runs(crowd, done, needed - done))
        done = needed
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def links_in(sets: list[np.ndarray], first: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets at or above the threshold: within all (`same`), or between the first `first` and the others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.float64)
    width = max(256, (1 << 21) // max(n, 1))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        grid = np.zeros((n, width), np.float32)
        grid[owner[lo:hi], column[lo:hi] - a] = 1
        common += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - common
    hit = np.triu(common >= threshold * union - 1e-9, 1)
    if not same:
        hit[:first, :first] = False
        hit[first:, first:] = False
    return np.nonzero(hit)


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """Streams (cell, side, node, copies, tokens): for each node with links, the number of linked documents of other
    nodes and one node that it is connected to within the cell."""

    def settle(side, nodes, copies, tokens):
        order = np.argsort(side, kind="stable")
        sets = [np.frombuffer(tokens[i], "<u8") for i in order]
        first = int((np.asarray(side) == 0).sum())
        a, b = links_in(sets, first, first == len(sets), threshold)
        count, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        own = np.array([copies[i] for i in order], np.int64)
        np.add.at(count, a, own[b])
        np.add.at(count, b, own[a])

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        linked = np.flatnonzero(count)
        return [nodes[order[i]] for i in linked], count[linked], [nodes[order[top(i)]] for i in linked]

    def run(batches):
        held: list[list] = [[], [], [], []]
        for _, columns, begins, ends in _runs(batches, "cell", ("side", "node", "copies", "tokens")):
            if begins:
                held = [[], [], [], []]
            for h, c in zip(held, columns):
                h.extend(c.to_pylist())
            if ends and len(held[0]) > 1:
                nodes, count, tops = settle(*held)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(count), pa.array(tops, pa.binary())], names=["node", "links", "top"])

    return groups.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "node binary, links long, top binary")


ID = "struct(doc is null as none, doc, body)"


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc, body and node of each row; and node, first (the id of the class: see `ID`), copies and links of each node."""
    keyed = _keyed(docs, id_col, text_col)
    rows = checkpoint(embedded(keyed, runs_for(recall, threshold)))
    nodes = checkpoint(rows.groupBy("node").agg(F.min(F.expr(ID)).alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch"), F.any_value("paths").alias("paths")))
    group = components(near_edges(nodes, threshold, recall), "node", "other").withColumnRenamed("root", "super")
    sizes = group.groupBy("super").agg(F.count(F.lit(1)).alias("n"))
    narrow = F.least(F.ceil(F.col("n") / BLOCK), F.greatest(F.lit(WIDE), F.ceil(F.col("n") / MAX_BLOCK)))
    parts = F.when(F.col("n") <= 2 * BLOCK, F.lit(1)).otherwise(narrow.cast("int"))
    placed = group.join(sizes, "super").withColumn("blocks", parts).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    chosen = checkpoint(placed.join(nodes.select("node", "id.*", "copies"), "node"))

    def tokens(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("text").to_pylist())
        own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        kept = part.append_column("tokens", pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())).drop_columns(["text"])
        return kept.filter(pa.array([a == b for a, b in zip(own, part.column("node").to_pylist())]))

    # The text of one row of each node.
    same = F.expr("t.body = c.body and t.doc <=> c.doc")
    fetched = keyed.alias("t").join(chosen.hint("shuffle_hash").alias("c"), same).select("super", "blocks", "block", "node", "copies", "text")
    sets = map_slices(fetched, lambda: tokens, "super binary, blocks int, block int, node binary, copies long, tokens binary")
    pairs = F.expr("explode(transform(sequence(0, blocks - 1), o -> struct(least(o, block) as lo, greatest(o, block) as hi)))")
    cells = sets.dropDuplicates(["node"]).withColumn("p", pairs).select(
        F.xxhash64("super", "p.lo", "p.hi").alias("cell"), F.when(F.col("block") == F.col("p.lo"), 0).otherwise(1).alias("side"), "node", "copies", "tokens"
    )
    linked = checkpoint(verified(cells, threshold))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(linked.where("node <> top"), "node", "top")
    known = nodes.select("node", "id", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = checkpoint(known)
    named = known.groupBy("root").agg(F.min("id").alias("first"))
    return rows, known.join(named, "root").select("node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, class_id, class_text, n_copies and n_links of each row.

    class_id is the smallest id of the class (null if it has none), class_text the smallest hash of a text that this id
    has in the class (together they name the class also where ids repeat), n_copies the number of rows with the same
    shingles (itself included), and n_links the number of other rows at or above the threshold, copies included."""
    rows, by_node = _classes(docs, threshold, recall, id_col, text_col)
    named = by_node.select("node", F.col("first.doc").alias("class_id"), F.col("first.body").alias("class_text"), F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc", "node").join(named, "node").select("doc", "class_id", "class_text", "n_copies", "n_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, one with the class's id and text, with the same columns."""
    rows, by_node = _classes(docs, threshold, recall, id_col, text_col)
    first = by_node.selectExpr("first.doc is null as first_none", "coalesce(first.doc, 0L) as first_doc", "first.body as first_body").distinct()
    none, doc, body = new_names(docs, "none", "doc", "body")
    marked = docs.withColumns({none: F.col(id_col).isNull(), doc: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), body: text_hash(text_col)})
    same = (F.col(none) == F.col("first_none")) & (F.col(doc) == F.col("first_doc")) & (F.col(body) == F.col("first_body"))
    kept = marked.join(first.hint("shuffle_hash"), same, "left_semi")
    if rows.groupBy("doc", "body").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():  # rows with the same id and text
        kept = kept.dropDuplicates([none, doc, body])
    return kept.drop(none, doc, body)
