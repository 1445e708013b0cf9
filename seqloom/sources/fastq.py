"""FASTQ and FASTA: record readers and data sources.

A FASTQ record has four lines. A header that does not begin with @ is counted and skipped by one line; a record that
the file's end cuts off is dropped; the id is the first word after the @, or "unknown"; a record with a quality below
"!" is bad and left out (`bad_records` counts such).

Files are read in byte ranges, and the records are those of one sequential reader, whatever the ranges and however damaged
the file is. Where a range begins it is not known which of a record's four lines comes first. So all four possibilities
are followed line by line: a line that is no header sends the reader that expects one, and the reader of a last line,
to the same state, so that soon only one is left, which expects a header. Each range begins at this place and reads on to
that of the next range. A range in which no such place is found (say, because every quality begins with @) is read
by the range before it.

Blocks of a range are decoded as arrays: places of line ends give headers, sequences and qualities; only blocks with
other than ASCII, or with white space around lines, go record by record.

Every record has a number `nr` that no other record of the same load has: its file's place in the listing, times 2^40,
plus the byte at which the record begins (FASTQ, whatever the ranges) or its count in the file (FASTA); `bam` says how
its records are numbered."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.sources.files import listing, opened
from seqloom.sources.writers import Writer

SCHEMA = "file string, nr long, id string, seq string, quality array<smallint>"
ARROW = pa.schema([("file", pa.string()), ("nr", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("quality", pa.list_(pa.int16()))])
ROWS, RANGE, BLOCK = 8192, 64 << 20, 2 << 20
LAST = 1 << 62  # beyond every file


def lines(stream, start: int = 0) -> Iterator[tuple[int, str]]:
    """Lines with the place where they begin, without their ends."""
    stream.seek(start)
    place, rest = start, b""
    while True:
        block = stream.read(1 << 20)
        if not block:
            break
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            yield place, part.decode("utf-8", "replace").rstrip("\r")
            place += len(part) + 1
    if rest:
        yield place, rest.decode("utf-8", "replace").rstrip("\r")


def decode_quality(text: str) -> list[int] | None:
    """Scores, or none if a character lies below "!"."""
    scores = [ord(c) - 33 for c in text]
    return None if scores and min(scores) < 0 else scores


def fastq_records(source: Iterator[tuple[int, str]], bad: bool = False) -> Iterator[tuple[int, str, str, list[int]]]:
    """place, id, sequence and qualities of the good records, or of the bad ones (without qualities)."""
    source = iter(source)
    for place, header in source:
        if not header.startswith("@"):
            continue
        sequence, plus, quality = next(source, None), next(source, None), next(source, None)
        if sequence is None or plus is None or quality is None:
            return
        words = header[1:].split()
        scores = decode_quality(quality[1].strip())
        if (scores is None) == bad:
            yield place, words[0] if words else "unknown", sequence[1].strip(), scores


def raw_lines(stream, start: int, block: int) -> Iterator[tuple[int, bytes]]:
    """Places and first bytes (empty for an empty line) of the lines that begin at or after a place."""
    at = max(start - 1, 0)
    stream.seek(at)
    fresh, place = start == 0, start
    while data := stream.read(block):
        begin = 0
        while True:
            if fresh:
                if begin == len(data):
                    break
                yield place, data[begin : begin + 1].strip(b"\n")
                fresh = False
            end = data.find(b"\n", begin)
            if end < 0:
                break
            begin = end + 1
            fresh, place = True, at + begin
        at += len(data)


def sync_point(stream, start: int, end: int) -> int | None:
    """The first line from `start` on, and before `end`, at which readers in all four states agree: they expect a header."""
    if start == 0:
        return 0
    states = {0, 1, 2, 3}
    for place, first in raw_lines(stream, start, 1 << 14):
        if place >= end:
            return None
        if states == {0}:
            return place
        states = {1 if s == 0 and first == b"@" else 0 if s == 0 else (s + 1) % 4 for s in states}
    return None


def record_lines(is_header: np.ndarray) -> np.ndarray:
    """The lines at which records begin, for lines of which the first is expected to be a header."""
    n = len(is_header)
    at = np.arange(n)
    headers = np.flatnonzero(is_header)
    stops = np.full(n + 4, n)  # by line: the first line at this distance of whole records that is no header
    for r in range(4):
        own = at[r::4]
        stop = np.where(is_header[own], n + 4, own)
        stops[own] = np.minimum.accumulate(stop[::-1])[::-1]
    found, line = [], 0
    while True:
        i = np.searchsorted(headers, line)
        if i == len(headers):
            break
        line = int(headers[i])
        stop = min(int(stops[line]), line + 4 * ((n - line + 3) // 4))
        found.append(np.arange(line, stop, 4))
        line = stop
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def part_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the pieces from start to end, which follow each other, and their offsets."""
    mark = np.zeros(len(data) + 1, np.int8)
    full = end > start
    np.add.at(mark, start[full], 1)
    np.add.at(mark, end[full], -1)
    return data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)], np.concatenate([[0], np.cumsum(end - start)])


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def decoded(raw: bytes, place: int, file: str, number: int, bad: bool) -> tuple[pa.RecordBatch, int]:
    """The records of a block that begins where a header is expected and ends with a line's end, and the bytes that belong to
    records as a whole (what follows is the begin of a record)."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines_ = record_lines(data[starts] == 64)
    open_ = lines_[lines_ + 3 >= len(starts)]
    used = int(starts[open_[0]]) if len(open_) else len(raw)
    lines_ = lines_[lines_ + 3 < len(starts)]
    space = data <= 32
    id_start, quality_start, quality_end, seq_start, seq_end = starts[lines_] + 1, starts[lines_ + 3], ends[lines_ + 3], starts[lines_ + 1], ends[lines_ + 1]
    # The lines' ends of other systems.
    quality_end = quality_end - ((quality_end > quality_start) & (data[quality_end - 1] == 13))
    seq_end = seq_end - ((seq_end > seq_start) & (data[seq_end - 1] == 13))
    edges = lambda a, b: (space[np.minimum(a, len(data) - 1)] | space[b - 1]) & (b > a)
    odd = (data > 127).any() or edges(seq_start, seq_end).any() or edges(quality_start, quality_end).any() or (((data < 9) | (data > 13)) & (data < 32) & (data > 27)).any()
    spaces = np.flatnonzero(space)
    id_end = spaces[np.searchsorted(spaces, id_start)] if len(lines_) else id_start
    if odd or (id_end == id_start).any():  # names after white space, or none
        rows = list(fastq_records(lines(io.BytesIO(raw[:used])), bad))
        rows = [(file, number + place + nr, *r) for nr, *r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, ARROW.types)], schema=ARROW), used
    low = np.flatnonzero(data < 33)
    good = np.searchsorted(low, quality_start) == np.searchsorted(low, quality_end)
    keep = ~good if bad else good
    pick = lambda a, b: part_of(data, a[keep], b[keep])
    n = int(keep.sum())
    if bad:
        quality = pa.nulls(n, pa.list_(pa.int16()))
    else:
        values, offsets = pick(quality_start, quality_end)
        quality = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int16) - np.int16(33)))
    arrays = [pa.repeat(pa.scalar(file), n), pa.array(number + place + id_start[keep] - 1), text_array(*pick(id_start, id_end)), text_array(*pick(seq_start, seq_end)), quality]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW), used


def fastq_batches(stream, start: int, end: int, file: str, number: int, bad: bool = False, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The records from a place where a header is expected up to another, or the file's end."""
    stream.seek(start)
    at, held = start, b""  # held: bytes read from `at` on
    while True:
        data = stream.read(min(max(block, len(held)), end - at - len(held)))
        held += data
        cut = held.rfind(b"\n") + 1
        if not data and len(held) > cut:  # the last line lacks its end
            held += b"\n"
            cut = len(held)
        if cut:
            batch, used = decoded(held[:cut], at, file, number, bad)
            for i in range(0, batch.num_rows, ROWS):
                yield batch.slice(i, ROWS)
            at, held = at + used, held[used:]
        if not data:
            return


def fasta_records(source: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str, str, None]]:
    """number, id and sequence; lines are trimmed and joined, and records without id or sequence dropped."""
    name, parts, nr = "", [], 0

    def whole():
        return nr, name, "".join(parts), None

    for _, text in source:
        text = text.strip()
        if text.startswith(">"):
            if name and parts:
                yield whole()
            nr += 1
            words = text[1:].split()
            name, parts = words[0] if words else "", []
        elif text:
            parts.append(text)
    if name and parts:
        yield whole()


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, file: int = 0):
        self.path, self.start, self.end, self.file = path, start, end, file


def batches(part: Part, records, schema: pa.Schema = ARROW, bits: int = 40) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for nr, *record in records:
        held.append((part.path, (part.file << bits) + nr, *record))
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.bad = str(options.get("bad", "false")).lower() == "true"
        self.range = int(options.get("rangebytes", RANGE))

    def partitions(self):
        out = []
        for i, (name, size) in enumerate(listing(self.path)):
            cuts = range(0, max(size, 1), self.range) if self.kind == "fastq" else [0]
            out += [Part(name, at, size, i) for at in cuts]
        return out

    def read(self, partition):
        with opened(partition.path) as stream:
            if self.kind == "fasta":
                yield from batches(partition, fasta_records(lines(stream)))
                return
            size, at = partition.end, partition.start
            begin = sync_point(stream, at, min(at + self.range, size))
            if begin is None:
                return
            end = None
            while end is None and (at := at + self.range) < size:
                end = sync_point(stream, at, min(at + self.range, size))
            yield from fastq_batches(stream, begin, LAST if end is None else end, partition.path, partition.file << 40, self.bad)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader("fastq", self.options)

    def writer(self, schema, overwrite):
        return Writer(self.name(), self.options, schema.fieldNames(), overwrite)


class FastaSource(FastqSource):
    @classmethod
    def name(cls):
        return "fasta"

    def reader(self, schema):
        return _Reader("fasta", self.options)


def read_fastq(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """file, nr, id, seq, quality of the good records."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("rangebytes", range_bytes).load(path)


def bad_records(spark: SparkSession, path: str) -> int:
    """How many records have a quality below "!"."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("bad", "true").load(path).count()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").load(path)


def numbered(reads: DataFrame) -> DataFrame:
    """The reads with read_idx: their number, which is unique in a load."""
    return reads.selectExpr("nr as read_idx", "*")
