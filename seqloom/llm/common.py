"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import storage

#: Bytes of text that an Arrow slice handed to Python code may hold (a single longer row is a slice of its own).
SLICE_BYTES = 2 << 20


class Memo(dict):
    """Values computed by `make` at first use and kept in two generations of at most `size` keys: when the young one is
    full it becomes the old one, and keys met again are taken over."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so that extra columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def new_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the table has no column of that name in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column holds at most `limit` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over slices; `make` runs once a task and returns the function of a slice. Spark's own batches are bounded
    by what `seqloom.session` sets."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, column):
                yield f(part)

    return df.mapInArrow(run, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder with their lineage cut."""
    return storage.checkpoint(df)
