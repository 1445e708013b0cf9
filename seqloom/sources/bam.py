"""BAM: block-compressed binary alignments, read and written without native libraries.

Follows the public SAM/BAM specification: BGZF blocks are gzip members with their size in an extra field; a record
holds name, flag, reference, packed bases and qualities.

A file of BGZF blocks is cut into byte ranges: a task reads the records that begin in the blocks of its range. Where the
first one begins is not marked; it is the first place where a record's fields, and those of the records that follow, hold
what the specification allows. A file that is plain gzip is read by one task.

What a query does not need is not decoded: the filters secondary, supplementary, unmapped (true or false) and length (at least)
reach the reader if Spark's setting for filters of Python sources is on, and are decided by a record's fixed fields; a
schema given on loading names the columns that are decoded. Names, bases and qualities of a few megabytes of records are
decoded at once, as arrays.

A record's number within its file is 32 times the place of its block plus its rank among the records that begin there:
unique, as a compressed byte stands for less than 32 records of at least 36 bytes each."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, IsNotNull, Not

from seqloom.sources.fastq import RANGE, ROWS, Part, part_of, text_array
from seqloom.sources.files import listing, opened
from seqloom.sources.writers import Writer

SCHEMA = "file string, nr long, id string, flag int, tid int, pos int, mapq int, seq string, quality array<smallint>, raw binary, secondary boolean, supplementary boolean, unmapped boolean, length int"
ARROW = pa.schema([("file", pa.string()), ("nr", pa.int64()), ("id", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("pos", pa.int32()), ("mapq", pa.int32()), ("seq", pa.string()), ("quality", pa.list_(pa.int16())), ("raw", pa.binary()), ("secondary", pa.bool_()), ("supplementary", pa.bool_()), ("unmapped", pa.bool_()), ("length", pa.int32())])
FLAGS = {"secondary": 0x100, "supplementary": 0x800, "unmapped": 0x4}
LETTERS = np.array([[ord("=ACMGRSVTWYHKDBN"[i >> 4]), ord("=ACMGRSVTWYHKDBN"[i & 15])] for i in range(256)], np.uint8)
HELD = 4 << 20  # bytes of records that are decoded at once
BASES = "=ACMGRSVTWYHKDBN"
_PAIR = [BASES[i >> 4] + BASES[i & 15] for i in range(256)]
_NUMBER = {b: i for i, b in enumerate(BASES)}
CHAIN = 8  # records that have to follow each other where a range begins
CONSUMING = (0, 1, 4, 7, 8)  # fixed values: alignment operations M, I, S, = and X, which take bases of the sequence
PLACE_BITS = 45  # of a record's number; files have those above
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@dataclass
class Header:
    text: str = ""
    references: list[tuple[str, int]] = field(default_factory=list)


class BadBam(ValueError):
    pass


def read_header(stream) -> Header:
    if stream.read(4) != b"BAM\1":
        raise BadBam("no BAM magic")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode("utf-8", "replace")
    references = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode()
        references.append((name, struct.unpack("<i", stream.read(4))[0]))
    return Header(text, references)


def decode_record(raw: bytes) -> tuple[str, int, int, int, int, str, list[int] | None]:
    """id, flag, tid, pos, mapq, seq, quality (null where it is missing)."""
    tid, pos, name_len, mapq, _, ops, flag, length = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + name_len
    name = raw[32 : at - 1].decode("utf-8", "replace")
    at += 4 * ops
    packed = raw[at : at + (length + 1) // 2]
    at += len(packed)
    if len(raw) < at + length:
        raise BadBam("a record is cut off")
    quality = raw[at : at + length]
    return name, flag, tid, pos, mapq, "".join(_PAIR[b] for b in packed)[:length], None if quality[:1] == b"\xff" else list(quality)


def bam_records(stream, keep_raw: bool = False) -> Iterator[tuple]:
    """number, fields and (if asked for) raw bytes of each record; one that cannot be decoded is counted and skipped."""
    nr = 0
    while len(head := stream.read(4)) == 4:
        nr += 1
        raw = stream.read(struct.unpack("<i", head)[0])
        try:
            yield nr, *decode_record(raw), raw if keep_raw else None
        except (BadBam, struct.error):
            continue


def block_size(head: bytes) -> int | None:
    """The size of the BGZF block that begins with these bytes, or none if no block does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """The bytes of the BGZF blocks from a place on, as one stream that knows the block of its next byte."""

    def __init__(self, stream, place: int = 0):
        self.stream, self.following, self.block, self.data, self.at = stream, place, place, b"", 0

    def _load(self) -> bool:
        self.stream.seek(self.following)
        held = self.stream.read(65_536)
        if not held:
            return False
        size = block_size(held)
        if size is None:
            raise BadBam(f"no block at byte {self.following}")
        if len(held) < size:
            raise EOFError("a block is cut off")
        start = 12 + struct.unpack_from("<H", held, 10)[0]
        self.data, self.at = zlib.decompress(held[start : size - 8], -15), 0
        if zlib.crc32(self.data) != struct.unpack_from("<I", held, size - 8)[0]:
            raise BadBam(f"wrong checksum at byte {self.following}")
        self.block, self.following = self.following, self.following + size
        return True

    def place(self) -> int | None:
        """The block of the next byte, or none at the end."""
        while self.at == len(self.data):
            if not self._load():
                return None
        return self.block

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and self.place() is not None:
            out.append(self.data[self.at : self.at + n])
            self.at += len(out[-1])
            n -= len(out[-1])
        return b"".join(out)


def block_spans(blocks: Blocks, end: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Bytes of records, and places, sizes and numbers of those within them that begin in blocks before `end`."""
    held, owners = bytearray(), []  # owners: where in `held` a block begins, and the block
    last, rank = -1, 0
    while True:
        block = blocks.place()
        if block is not None:
            owners.append((len(held), block))
            held += blocks.data[blocks.at :]
            blocks.at = len(blocks.data)
            if len(held) < HELD and block < end:
                continue
        at, turn, offsets, sizes, numbers, over = 0, 0, [], [], [], False
        while at + 4 <= len(held):
            while turn + 1 < len(owners) and owners[turn + 1][0] <= at:
                turn += 1
            if owners[turn][1] >= end:
                over = True
                break
            size = int.from_bytes(held[at : at + 4], "little", signed=True)
            if at + 4 + size > len(held):
                break
            last, rank = owners[turn][1], rank + 1 if owners[turn][1] == last else 0
            offsets.append(at + 4)
            sizes.append(size)
            numbers.append(last * 32 + rank)
            at += 4 + size
        if offsets:
            yield bytes(held), offsets, sizes, numbers
        if over or block is None:
            return
        del held[:at]
        owners = [(max(begin - at, 0), place) for i, (begin, place) in enumerate(owners) if i + 1 == len(owners) or owners[i + 1][0] > at]


def stream_spans(stream) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """The same for a stream of records, which are numbered from 1."""
    held, nr = bytearray(), 0
    while data := stream.read(HELD):
        held += data
        at, offsets, sizes = 0, [], []
        while at + 4 <= len(held):
            size = int.from_bytes(held[at : at + 4], "little", signed=True)
            if at + 4 + size > len(held):
                break
            offsets.append(at + 4)
            sizes.append(size)
            at += 4 + size
        if offsets:
            yield bytes(held), offsets, sizes, list(range(nr + 1, nr + 1 + len(offsets)))
        nr += len(offsets)
        del held[:at]


def decode_spans(raw: bytes, offsets: list[int], sizes: list[int], numbers: list[int], file: str, number: int, columns: list[str], tests: list[tuple]) -> pa.RecordBatch:
    """The columns of the records that pass the tests (column, comparison, value); records that cannot be decoded are left out."""
    data = np.frombuffer(raw, np.uint8)
    at, size, nr = (np.array(x, np.int64) for x in (offsets, sizes, numbers))
    whole = size >= 32
    at, size, nr = at[whole], size[whole], nr[whole]
    fixed = data[at[:, None] + np.arange(20)]
    number_of = lambda a, b, kind: np.ascontiguousarray(fixed[:, a:b]).view(kind)[:, 0].astype(np.int64)
    flag, length, ops, name_len = number_of(14, 16, "<u2"), number_of(16, 20, "<i4"), number_of(12, 14, "<u2"), fixed[:, 8].astype(np.int64)
    packed = (length + 1) // 2
    keep = (length >= 0) & (name_len > 0) & (32 + name_len + 4 * ops + packed + length <= size)
    value = {"flag": flag, "length": length} | {c: (flag & bit) != 0 for c, bit in FLAGS.items()}
    for column, compare, wanted in tests:
        own = value[column]
        keep &= own == wanted if compare == "=" else own >= wanted if compare == ">=" else own > wanted
    rows = np.flatnonzero(keep)
    at, size, nr, fixed, flag, length, name_len, ops, packed = (x[rows] for x in (at, size, nr, fixed, flag, length, name_len, ops, packed))
    names, bases = at + 32, at + 32 + name_len + 4 * ops

    def column(c: str) -> pa.Array:
        if c == "file":
            return pa.repeat(pa.scalar(file), len(rows))
        if c == "nr":
            return pa.array(number + nr)
        if c in ("flag", "length"):
            return pa.array((flag if c == "flag" else length).astype(np.int32))
        if c in FLAGS:
            return pa.array((flag & FLAGS[c]) != 0)
        if c == "mapq":
            return pa.array(fixed[:, 9].astype(np.int32))
        if c in ("tid", "pos"):
            return pa.array(number_of(0, 4, "<i4").astype(np.int32) if c == "tid" else number_of(4, 8, "<i4").astype(np.int32))
        if c == "id":
            own, ends = part_of(data, names, names + name_len - 1)
            if (own > 127).any():
                return pa.array([raw[a : a + n - 1].decode("utf-8", "replace") for a, n in zip(names.tolist(), name_len.tolist())], pa.string())
            return text_array(own, ends)
        if c == "seq":
            own, ends = part_of(data, bases, bases + packed)
            letters = LETTERS[own].ravel()
            odd = length % 2 == 1
            stay = np.ones(len(letters), bool)
            stay[2 * ends[1:][odd] - 1] = False
            return text_array(letters[stay], np.concatenate([[0], np.cumsum(length)]))
        if c == "quality":
            start = bases + packed
            own, ends = part_of(data, start, start + length)
            missing = (length > 0) & (data[np.minimum(start, len(data) - 1)] == 255)
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own.astype(np.int16)), mask=pa.array(missing))
        own, ends = part_of(data, at, at + size)
        return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])

    def made(c: str) -> pa.Array:
        return pa.nulls(len(rows), pa.binary()) if c == "no_raw" else column(c)

    return pa.RecordBatch.from_arrays([made(c) for c in columns], schema=pa.schema([ARROW.field("raw" if c == "no_raw" else c) for c in columns]))


def first_block(stream, start: int, end: int) -> int | None:
    """The first block that begins in the range: its size leads to another block or to the file's end."""
    stream.seek(0, 2)
    length, at = stream.tell(), start
    while at < end:
        stream.seek(at)
        held = stream.read(2 * 65_536)
        found = held.find(b"\x1f\x8b\x08\x04")
        while 0 <= found < 65_536 and at + found < end:
            size = block_size(held[found:])
            if size is not None:
                stream.seek(at + found + size)
                after = stream.read(4)
                if at + found + size == length or after == b"\x1f\x8b\x08\x04":
                    try:
                        Blocks(stream, at + found).place()
                        return at + found
                    except (BadBam, EOFError, zlib.error, struct.error):
                        pass
            found = held.find(b"\x1f\x8b\x08\x04", found + 1)
        at += 65_536
    return None


def plausible(raw: bytes, references: int) -> int | None:
    """The size of the record, its size field included, if these bytes can begin one."""
    if len(raw) < 37:
        return None
    size, tid, pos, name_len, _, _, ops, _, length, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw)
    if not (-1 <= tid < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and length >= 0 and name_len):
        return None
    if size < 32 + name_len + 4 * ops + (length + 1) // 2 + length:
        return None
    name = raw[36 : 36 + name_len]
    if len(name) < name_len or name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    return size + 4


def first_record(stream, start: int, end: int, references: int) -> Blocks | None:
    """The blocks from the first record on that begins in a block of the range."""
    place = first_block(stream, start, end)
    while place is not None and place < end:
        blocks = Blocks(stream, place)
        if (here := blocks.place()) is None or here >= end:
            return None
        data, following = blocks.data, blocks.following
        ahead = data + Blocks(stream, following).read(512)
        for at in range(len(data)):
            if plausible(ahead[at : at + 320], references) and _chained(stream, here, at, references):
                blocks.at = at
                return blocks
        place = following
    return None


def _chained(stream, place: int, at: int, references: int) -> bool:
    """Whether records follow each other from there, up to a number or the file's end; their alignments have to be as long
    as their sequences."""
    blocks = Blocks(stream, place)
    blocks.place()
    blocks.at = at
    for i in range(CHAIN):
        head = blocks.read(36)
        if not head:
            return True
        head += blocks.read(head[12] if len(head) == 36 else 0)
        size = plausible(head, references)
        if size is None:
            return False
        ops, length = struct.unpack_from("<H", head, 16)[0], struct.unpack_from("<i", head, 20)[0]
        alignment = blocks.read(4 * ops)
        if ops and length and sum(op >> 4 for (op,) in struct.iter_unpack("<I", alignment[: len(alignment) & ~3]) if op & 15 in CONSUMING) != length:
            return False
        rest = size - len(head) - len(alignment)
        while rest > 0 and blocks.place() is not None:  # skipped, not held
            step = min(rest, len(blocks.data) - blocks.at)
            blocks.at += step
            rest -= step
        if rest:
            return i > 0  # the file is cut off
    return True


def is_bam(path: str) -> bool:
    """Whether the file opens as block-compressed BAM."""
    try:
        with opened(path) as f, gzip.open(f) as stream:
            return stream.read(4) == b"BAM\1"
    except (OSError, EOFError, zlib.error):
        return False


def header_of(path: str) -> Header:
    with opened(path) as f, gzip.open(f) as stream:
        return read_header(stream)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, raw = options["path"], str(options.get("raw", "false")).lower() == "true"
        self.columns = [c if c != "raw" or raw else "no_raw" for c in columns]
        self.range = int(options.get("rangebytes", RANGE))
        self.tests: list[tuple] = []

    def partitions(self):
        out = []
        for i, (name, size) in enumerate(listing(self.path)):
            with opened(name) as stream:
                cut = block_size(stream.read(65_536)) is not None
            if cut and size >> PLACE_BITS - 5:
                raise ValueError(f"{name} is too long for the numbers of its records")
            out += [Part(name, at, min(at + self.range, size), i) for at in range(0, size, self.range)] if cut else [Part(name, 0, None, i)]
        return out

    def _decoded(self, partition, spans):
        for span in spans:
            batch = decode_spans(*span, partition.path, partition.file << PLACE_BITS, self.columns, self.tests)
            for i in range(0, batch.num_rows, ROWS):
                yield batch.slice(i, ROWS)

    def read(self, partition):
        with opened(partition.path) as stream:
            if partition.end is None:
                with gzip.open(stream) as plain:
                    read_header(plain)
                    yield from self._decoded(partition, stream_spans(plain))
                return
            blocks = Blocks(stream)
            references = len(read_header(blocks).references)
            first = blocks.place()  # the header may reach into later ranges
            if first is None or first >= partition.end:
                return
            if first < partition.start:
                blocks = first_record(stream, partition.start, partition.end, references)
            if blocks is not None:
                yield from self._decoded(partition, block_spans(blocks, partition.end))


class _Filtering(_Reader):
    def pushFilters(self, filters):
        """Keeps the tests of fixed fields; the others stay with Spark."""
        for f in filters:
            same = f.child if isinstance(f, Not) else f
            column = getattr(same, "attribute", None)
            name = column[0] if column and len(column) == 1 else None
            if isinstance(same, EqualTo) and (name in FLAGS or name == "flag" and same is f):
                self.tests.append((name, "=", same.value if same is f else not same.value))
            elif name == "length" and type(f) in (GreaterThan, GreaterThanOrEqual):
                self.tests.append((name, ">=" if isinstance(f, GreaterThanOrEqual) else ">", f.value))
            elif not (isinstance(f, IsNotNull) and (name in FLAGS or name in ("flag", "length"))):  # these never are
                yield f


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        # Spark takes no reader of filters while its setting is off.
        return (_Filtering if str(self.options.get("filters", "false")).lower() == "true" else _Reader)(self.options, schema.fieldNames())

    def writer(self, schema, overwrite):
        return Writer(self.name(), self.options, schema.fieldNames(), overwrite)


def read_bam(spark: SparkSession, path: str, raw: bool = False, columns: list[str] | None = None) -> DataFrame:
    """All records, in the orientation in which they are stored; tasks read ranges of a file. With `raw`, the record's bytes
    come along, for exports that keep alignment and tags. Only `columns` are decoded, if they are given."""
    spark.dataSource.register(BamSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    source = spark.read.format("bam").option("raw", str(raw).lower()).option("filters", filters)
    if columns:
        kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
        source = source.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return source.load(path)


def encode_record(name: str, flag: int, tid: int, pos: int, mapq: int, seq: str, quality: list[int] | None) -> bytes:
    packed = bytearray((len(seq) + 1) // 2)
    for i, base in enumerate(seq.upper()):
        packed[i >> 1] |= _NUMBER.get(base, 15) << (0 if i & 1 else 4)
    scores = bytes(quality) if quality is not None else b"\xff" * len(seq)
    key = name.encode()[:254] + b"\0"
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(key), mapq, 4680, 0, flag, len(seq), -1, -1, 0) + key + bytes(packed) + scores
    return struct.pack("<i", len(body)) + body


class BgzfWriter:
    """Writes bytes as BGZF blocks to a binary stream, what is held on flushing, and the end marker on closing."""

    def __init__(self, stream):
        self.stream, self.held = stream, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= 65_000:
            self._block(bytes(self.held[:65_000]))
            del self.held[:65_000]

    def _block(self, part: bytes) -> None:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        self.stream.write(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))

    def flush(self) -> None:
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.stream.write(END_OF_FILE)


def encode_header(header: Header) -> bytes:
    text = header.text.encode()
    out = bytearray(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(header.references)))
    for name, length in header.references:
        key = name.encode() + b"\0"
        out += struct.pack("<i", len(key)) + key + struct.pack("<i", length)
    return bytes(out)


def moved_record(raw: bytes, tids: dict[int, int]) -> bytes | None:
    """The record with its size before it and its reference renumbered; None if it is mapped to a reference that is not
    among the new ones."""
    tid, flag = struct.unpack_from("<i", raw)[0], struct.unpack_from("<H", raw, 14)[0]
    if not flag & 4:
        if tid not in tids:
            return None
        raw = struct.pack("<i", tids[tid]) + raw[4:]
    return struct.pack("<i", len(raw)) + raw


def minimal_header(source: Header, tids: list[int]) -> tuple[Header, dict[int, int]]:
    """HD, PG, RG and CO lines and only the references in use, with the new number of each; without any, one dummy."""
    kept = [x for x in source.text.splitlines() if x[:3] in ("@HD", "@PG", "@RG", "@CO")]
    used = [t for t in sorted(set(tids)) if 0 <= t < len(source.references)]
    references = [source.references[t] for t in used] or [("unmapped", 1)]
    lines = [x for x in kept if x.startswith("@HD")] + [f"@SQ\tSN:{n}\tLN:{length}" for n, length in references] + [x for x in kept if not x.startswith("@HD")]
    return Header("".join(f"{x}\n" for x in lines), references), {t: i for i, t in enumerate(used)}
