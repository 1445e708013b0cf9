"""Line dedup over a corpus, with keep bitmaps.

Long lines become rows of two hashes of the key, the document and the position. The rows are range-partitioned by
hash and document and sorted within partitions by hash, document (largest first) and position; each partition is then
streamed once: the first document of a key keeps its lines, and the others lose theirs as soon as enough documents
have been seen. A key may fill several partitions, so that no key has to fit in one: the first and last key of a
partition are settled by at most two summary rows from each partition. The result is a compressed bitmap of the kept
lines for each document that loses any; lines are dropped and texts put together again in SQL functions, so no text
leaves the JVM.

A line's key is the line without white space (space, 9-13) at its ends and with A-Z lower-cased. Keys of at least
`min_chars` code points that are found in at least `min_docs` documents lose all their lines except those in the
largest id that holds the key.

Defined results: a null or empty text is one empty line; null ids are one document, below all others; rows with the
same id are one document, and each row has its own bitmap; other columns pass through `drop_lines`.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, new_names, texts

MIN_CHARS, MIN_DOCS = 40, 5
WHITE = " \t\n\v\f\r"
NO_ID = -(2**63)

ROW = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])
DROPPED, OPEN, SUMMARY = 0, 1, 2


def line_key(line: Column) -> Column:
    """lower() would change other letters than A-Z as well, but is fast and right where all are ASCII."""
    own = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(own) == F.octet_length(own), F.lower(own)).otherwise(F.translate(own, string.ascii_uppercase, string.ascii_lowercase))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, doc, body (hash of the whole text) and pos of each line with a long key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"))
    lines = base.select("doc", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)
    keys = lines.select("doc", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "body", "pos")


def _rows(kind: int, part: dict[str, np.ndarray], n: int = 0) -> pa.RecordBatch:
    size = len(part["h1"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), *[pa.array(part[k]) for k in ("h1", "h2", "doc", "body")], pa.array(part["pos"].astype(np.int32)), pa.array(np.full(size, n, np.int64))], schema=ROW)


def stream(batches, min_docs: int):
    """One sorted partition: rows to drop, rows of open keys, and the summaries of the first and last key.

    Held between batches: the rows of a last key that fewer than `min_docs` documents have had so far."""
    names = ("h1", "h2", "doc", "body", "pos")
    held: dict[str, np.ndarray] | None = None  # rows of the last key that wait for a decision
    key, count, top, last_doc, first = None, 0, 0, None, True  # the last key so far, its documents, largest and last document, and whether it is the partition's first

    def take(part, mask):
        return {k: v[mask] for k, v in part.items()}

    def summary():
        return _rows(SUMMARY, {"h1": np.array([key[0]]), "h2": np.array([key[1]]), "doc": np.array([top]), "body": np.array([0]), "pos": np.array([0])}, count)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        h1, h2, doc = part["h1"], part["h2"], part["doc"]
        new_key = np.empty(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_key[0] = key != (h1[0], h2[0])
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        if not new_key[0]:
            new_doc[0] = doc[0] != last_doc
        starts = np.flatnonzero(new_key)
        if not len(starts) or starts[0] > 0:
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], len(h1))
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        tops = doc[starts].copy()
        if not new_key[0]:  # the first run goes on with the held key
            counts[0] += count
            tops[0] = top
        elif key is not None:  # the held key ended with the last batch: too few documents, or an open first key
            if first:
                yield summary()
            first, held = False, None
        run = np.repeat(np.arange(len(starts)), ends - starts)
        if first:  # all rows of the partition's first key are open
            mask = run == 0
            yield _rows(OPEN, take(part, mask))
            if len(starts) > 1:
                key, count, top = (int(h1[0]), int(h2[0])), int(counts[0]), int(tops[0])
                yield summary()
        skip = 1 if first else 0
        if held is not None and counts[0] >= min_docs:
            mask = held["doc"] != top
            if mask.any():
                yield _rows(DROPPED, take(held, mask))
            held = None
        drop = (counts[run] >= min_docs) & (doc != tops[run]) & (run >= skip)
        if drop.any():
            yield _rows(DROPPED, take(part, drop))
        last = len(starts) - 1
        key, count, top, last_doc = (int(h1[-1]), int(h2[-1])), int(counts[-1]), int(tops[-1]), int(doc[-1])
        if last > 0:
            first, held = False, None
        if not first and count < min_docs:
            own = take(part, run == last)
            held = own if held is None else {k: np.concatenate([held[k], own[k]]) for k in names}
    if key is not None:
        if held is not None:
            yield _rows(OPEN, held)
        yield summary()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, body, pos of each line to drop."""
    rows = checkpoint(line_rows(docs, id_col, text_col, min_chars))
    order = (F.col("h1"), F.col("h2"), F.col("doc").desc())
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    out = checkpoint(sorted_rows.mapInArrow(lambda batches: stream(batches, min_docs), "kind tinyint, h1 long, h2 long, doc long, body long, pos int, n long"))
    # At most two rows a partition, whatever the number of rows.
    totals = out.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("top"))
    late = out.where(F.col("kind") == OPEN).join(F.broadcast(totals), ["h1", "h2"]).where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("top")))
    return out.where(F.col("kind") == DROPPED).select("doc", "body", "pos").unionByName(late.select("doc", "body", "pos"))


def runs_of(positions: Column) -> Column:
    """The keep bitmap of ascending dropped positions, compressed to the lengths of its runs: kept lines, dropped lines,
    kept lines and so on, from the first line; the lines after the last run are kept. Linear in the positions."""
    before = F.filter(F.transform(positions, lambda p, i: p - F.coalesce(F.get(positions, i - 1), F.lit(-1)) - 1), lambda gap, i: (i == 0) | (gap > 0))
    starts = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    ends = F.filter(positions, lambda p, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) != p + 1))
    runs = F.arrays_zip(before.alias("kept"), starts.alias("start"), ends.alias("end"))
    return F.flatten(F.transform(runs, lambda x: F.array(x["kept"], x["end"] - x["start"] + 1)))


def kept_lines(text: Column, runs: Column) -> Column:
    """The text without the lines that the bitmap drops. Linear in the lines."""
    bits = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.zip_with(F.split(text, "\n"), bits, lambda line, bit: F.struct(line.alias("line"), bit.alias("bit")))
    return F.array_join(F.transform(F.filter(marked, lambda x: F.coalesce(x["bit"], F.lit(True))), lambda x: x["line"]), "\n")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, body, keep (compressed bitmap, see `runs_of`) and n_dropped of each document that loses lines."""
    by_doc = dropped_lines(docs, min_chars, min_docs, id_col, text_col).groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return by_doc.select("doc", "body", runs_of(F.col("dropped")).alias("keep"), F.size("dropped").cast("long").alias("n_dropped"))


def with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """The rows with two more columns, and their names (which the rows do not have): the bitmap, null where no line is
    dropped, and the number of dropped lines.

    The bitmaps, which are small, are hashed within each partition, so that texts are shuffled but never sorted."""
    doc, body, keep, n_dropped = new_names(docs, "doc", "body", "keep", "n_dropped")
    maps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).toDF(doc, body, keep, n_dropped).hint("shuffle_hash")
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(body))
    return docs.join(maps, same, "left").drop(doc, body), keep, n_dropped


def line_dedup_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row."""
    joined, keep, n_dropped = with_bitmaps(texts(docs, id_col, text_col), min_chars, min_docs, "doc_id", "text")
    kept = F.when(F.col(keep).isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), F.col(keep)))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    return joined.select("doc_id", lines.alias("n_lines"), F.coalesce(n_dropped, F.lit(0).cast("long")).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the same columns, the text without its dropped lines (null texts stay null)."""
    joined, keep, _ = with_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    text = F.when(F.col(keep).isNull(), F.col(text_col)).otherwise(kept_lines(F.col(text_col), F.col(keep)))
    return joined.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
