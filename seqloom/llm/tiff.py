"""Media columns: TIFF files as pages.

`tiff_pages` walks the image directories of each file and, behind each, its sub-directories, decodes uncompressed, PackBits,
LZW and deflate strips and tiles in either order of bits, undoes horizontal and floating-point prediction, unpacks samples
of 1, 2, 4, 8, 16, 32 or 64 bits (whole numbers, with or without sign, or floating point), and gives one row per page. `store_texts` is the writing side: it keeps the bytes
of a text as the 8-bit samples of one or more pages.

Defined results: a null text is the empty text; an empty text is one row of fill bytes; a null or unreadable file is
one row with page_no -1 and `error` set; a page that cannot be decoded has null pixels and `error` set, and the walk
goes on; repeated rows give repeated pages; other columns pass through unless `tiff_pages` adds one of that name, in
which case its own wins.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.common import map_slices, texts

NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 576, 128, 32, (192, 32)
#: compression, predictor, tiled
LAYOUTS = ((PACKBITS, 1, False), (ADOBE_DEFLATE, 2, True), (LZW, 1, False), (ADOBE_DEFLATE, 2, False), (PACKBITS, 1, True), (NONE, 1, False), (LZW, 2, True), (DEFLATE, 1, False))
_RUN = re.compile(rb"(.)\1{2,127}", re.S)

# Width in bits of the k-th code after a clear code (the width grows one code early), and where that code starts.
_K = np.arange(4096)
_CODE_BITS = np.select([_K <= 253, _K <= 765, _K <= 1789], [9, 10, 11], 12).astype(np.int64)
_CODE_AT = np.concatenate([[0], np.cumsum(_CODE_BITS)])
#: Codes between clear codes that the writer emits, so that entries end before 4094.
_SEGMENT = 3834


class TiffError(ValueError):
    pass


def packbits_encode(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = row[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(row):
        literal(at, m.start())
        out.append(257 - (m.end() - m.start()))
        out.append(row[m.start()])
        at = m.end()
    literal(at, len(row))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, got, n = [], 0, 0, len(data)
    while i < n and got < size:
        head = data[i]
        if head < 128:
            part = data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            part = data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
            continue
        out.append(part)
        got += len(part)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, nth = [CLEAR], [0]  # nth: each code's number since the last clear code

    def close(n: int) -> None:
        nth.extend(range(n))

    seen: dict[int, int] = {}
    free, segment, prefix = 258, 0, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = seen.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        seen[key] = free
        free += 1
        segment += 1
        prefix = byte
        if segment == _SEGMENT:
            codes.append(CLEAR)
            close(segment + 1)
            seen.clear()
            free, segment = 258, 0
    if prefix >= 0:
        codes.append(prefix)
        segment += 1
    codes.append(END)
    close(segment + 1)
    widths = _CODE_BITS[nth]
    left = np.asarray(codes, np.uint16) << (12 - widths).astype(np.uint16)
    bits = (left[:, None] >> np.arange(11, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(bits.astype(np.uint8)[np.arange(12) < widths[:, None]]).tobytes()


_BYTES = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, got, out = len(data) * 8, 0, 0, []
    while got < size and at + 9 <= total:
        n = int(np.searchsorted(_CODE_AT[1:], total - at, side="right"))
        where, width = at + _CODE_AT[:n], _CODE_BITS[:n]
        i = where >> 3
        codes = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) >> (24 - (where & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        end = int(stop[0]) if len(stop) else n
        entries, last = _BYTES[:], None
        for code in codes[:end].tolist():
            if last is None:
                if code > 255:
                    raise TiffError("LZW: first code is no byte")
                entry = entries[code]
            elif code < len(entries):
                entry = entries[code]
                entries.append(last + entry[:1])
            elif code == len(entries):
                entry = last + last[:1]
                entries.append(entry)
            else:
                raise TiffError("LZW: code not yet defined")
            out.append(entry)
            got += len(entry)
            last = entry
        if end == n or codes[end] == END:
            break
        at += int(_CODE_AT[end + 1])
    return b"".join(out)


def compress(data: np.ndarray, kind: int, predictor: int) -> bytes:
    """One strip or tile, rows by columns."""
    if predictor == 2:
        data = np.concatenate([data[:, :1], np.diff(data, axis=1)], axis=1)
    if kind == NONE:
        return data.tobytes()
    if kind == PACKBITS:
        return b"".join(packbits_encode(row.tobytes()) for row in data)
    if kind == LZW:
        return lzw_encode(data.tobytes())
    return zlib.compress(data.tobytes(), 1)


def expand(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        out = data
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (ADOBE_DEFLATE, DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise TiffError(f"compression {kind} is not supported")
    if len(out) < size:
        raise TiffError(f"a segment holds {len(out)} of {size} bytes")
    return out[:size]


def write_tiff(pages: list[tuple[np.ndarray, tuple[int, int, bool]]]) -> bytes:
    """Little-endian file of 8-bit grey pages, each with its compression, predictor and whether it is tiled."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image, (kind, predictor, tiled) in pages:
        height, width = image.shape
        if tiled:
            tw, th = TILE
            parts = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    tile = np.zeros((th, tw), np.uint8)
                    piece = image[y : y + th, x : x + tw]
                    tile[: piece.shape[0], : piece.shape[1]] = piece
                    parts.append(compress(tile, kind, predictor))
        else:
            parts = [compress(image[y : y + STRIP_ROWS], kind, predictor) for y in range(0, height, STRIP_ROWS)]
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part
            out += b"\0" * (len(out) & 1)

        def longs(values: list[int]) -> int:
            if len(values) == 1:
                return values[0]
            where = len(out)
            out.extend(struct.pack(f"<{len(values)}I", *values))
            return where

        at, sizes = longs(offsets), longs([len(p) for p in parts])
        tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, kind), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor)]
        tags += [(322, 4, 1, TILE[0]), (323, 4, 1, TILE[1]), (324, 4, len(parts), at), (325, 4, len(parts), sizes)] if tiled else [(273, 4, len(parts), at), (278, 4, 1, STRIP_ROWS), (279, 4, len(parts), sizes)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", *tag)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def directories(data: bytes):
    """The tags of each image directory, in file order and each followed by its sub-directories: {tag: values}, the byte
    order, and how deep it lies. A directory that was seen before ends its chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count, entry, offset, inline = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    seen, waiting = set(), [(at, 0)]
    while waiting:
        at, depth = waiting.pop()
        if not at or at in seen:
            continue
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        at += 8 if big else 2
        if n * entry > len(data):
            raise TiffError("a directory is longer than the file")
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at + i * entry)
            many = struct.unpack_from(order + offset, data, at + i * entry + 4)[0]
            if kind in _TYPES:
                form = _TYPES[kind]
                size = many * struct.calcsize("<" + form)
                where = at + i * entry + 4 + inline
                if size > inline:
                    where = struct.unpack_from(order + offset, data, where)[0]
                if where + size > len(data):
                    raise TiffError(f"tag {tag} lies beyond the file")
                tags[tag] = struct.unpack_from(f"{order}{many}{form}", data, where)
        yield tags, order, depth
        waiting.append((struct.unpack_from(order + offset, data, at + n * entry)[0], depth))
        waiting += [(sub, depth + 1) for sub in reversed(tags.get(330, ()))]


#: The most bytes that one byte of a file can stand for, by compression: LZW (12 bits for 4,096), deflate, PackBits.
MOST = {5: 2731, 8: 1032, 32946: 1032, 32773: 64}


def samples_of(raw: bytes, rows: int, across: int, depth: int, bits: int, kind: str, order: str, predictor: int) -> np.ndarray:
    """Rows by columns by samples of a segment whose rows begin at whole bytes; kind: u, i or f. Samples below eight bits
    take a byte each."""
    if bits < 8:
        line = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : across * depth * bits]
        part = (line.reshape(rows, across, depth, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        return np.cumsum(part, axis=1, dtype=np.uint8) & ((1 << bits) - 1) if predictor == 2 else part
    form = np.dtype(f"{order}{kind}{bits // 8}")
    if predictor == 3:  # differences of bytes, which lie by significance, the highest of all samples first
        if kind != "f":
            raise TiffError("predictor 3 is for floating-point samples")
        line = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, depth), axis=1, dtype=np.uint8)
        planes = line.reshape(rows, bits // 8, across * depth)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(form.newbyteorder(">")).reshape(rows, across, depth).astype(form.newbyteorder("="))
    if predictor == 2:  # differences of the samples' bits, whatever they stand for
        whole = np.frombuffer(raw, np.dtype(f"{order}u{bits // 8}")).reshape(rows, across, depth)
        return np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("=")).view(form.newbyteorder("="))
    return np.frombuffer(raw, form).reshape(rows, across, depth).astype(form.newbyteorder("="))


def decode_page(data: bytes, tags: dict, order: str) -> np.ndarray:
    """Rows by columns by samples."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    bits, kind, predictor, planar, numbers = one(258, 1), one(259, 1), one(317, 1), one(284, 1), one(339, 1)
    if len(set(tags.get(258, ()))) > 1 or len(set(tags.get(339, ()))) > 1:
        raise TiffError("samples of different kinds are not supported")
    sample = {1: "u", 2: "i", 3: "f", 4: "u"}.get(numbers, "")
    if bits not in {"u": (1, 2, 4, 8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64)}.get(sample, ()):
        raise TiffError(f"samples of {bits} bits and kind {numbers} are not supported")
    if predictor not in (1, 2, 3):
        raise TiffError(f"predictor {predictor} is not supported")
    tiled = 322 in tags
    tw, th = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    offsets, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not (width and height and tw and th and samples and offsets):
        raise TiffError("the page has no samples")
    if sizes is None:
        sizes = (len(data),) * len(offsets)
    depth, planes = (1, samples) if planar == 2 else (samples, 1)
    # Sizes are checked by arithmetic, before anything of the size that a header claims is made.
    if planes * -(-height // th) * -(-width // tw) > min(len(offsets), len(sizes)):
        raise TiffError("too few segments")
    line = -(-tw * depth * bits // 8)
    if height * width * samples * bits > 8 * len(data) * MOST.get(kind, 1) or th * line > len(data) * MOST.get(kind, 1):
        raise TiffError("the page claims more samples than the file can hold")
    out = np.zeros((height, width, samples), np.uint8 if bits < 8 else np.dtype(f"{sample}{bits // 8}"))
    cells = [(p, y, x) for p in range(planes) for y in range(0, height, th) for x in range(0, width, tw)]
    for (p, y, x), at, size in zip(cells, offsets, sizes):
        rows = th if tiled else min(th, height - y)
        stored = data[at : at + size]
        raw = expand(stored.translate(_MIRROR) if one(266, 1) == 2 else stored, kind, rows * line)
        part = samples_of(raw, rows, tw, depth, bits, sample, order, predictor)
        h, w = min(rows, height - y), min(tw, width - x)
        out[y : y + h, x : x + w, slice(p, p + 1) if planar == 2 else slice(None)] = part[:h, :w]
    return out


def read_pages(data: bytes | None):
    """A dictionary for each page; see the module's text for broken files."""
    blank = dict.fromkeys(("width", "height", "samples", "bits", "compression", "predictor", "pixels"))
    number, above = 0, []  # above: the pages that a sub-directory may belong to, by depth
    try:
        for tags, order, depth in directories(data or b""):
            above = [*above[:depth], number]
            row = blank | {"page_no": number, "parent": above[depth - 1] if depth else None, "error": None} | {k: tags.get(t, (d,))[0] for k, t, d in (("width", 256, None), ("height", 257, None), ("samples", 277, 1), ("bits", 258, 1), ("compression", 259, 1), ("predictor", 317, 1))}
            try:
                row["pixels"] = decode_page(data, tags, order).tobytes()
            except (TiffError, struct.error, zlib.error, ValueError, IndexError) as e:
                row["error"] = str(e) or "broken page"
            yield row
            number += 1
    except (TiffError, struct.error) as e:
        yield blank | {"page_no": -1, "parent": None, "error": str(e)}


PAGE_FIELDS = (("page_no", "int", pa.int32()), ("parent", "int", pa.int32()), ("width", "long", pa.int64()), ("height", "long", pa.int64()), ("samples", "int", pa.int32()), ("bits", "int", pa.int32()), ("compression", "int", pa.int32()), ("predictor", "int", pa.int32()), ("pixels", "binary", pa.binary()), ("error", "string", pa.string()))


def page_batch(part: pa.RecordBatch, column: str, kept: list[str]) -> pa.RecordBatch:
    rows, source = [], []
    for i, data in enumerate(part.column(column).to_pylist()):
        for row in read_pages(data):
            rows.append(row)
            source.append(i)
    take = part.select(kept).take(pa.array(source, pa.int64()))
    arrays = take.columns + [pa.array([r[k] for r in rows], t) for k, _, t in PAGE_FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=kept + [k for k, _, _ in PAGE_FIELDS])


def tiff_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each file in `column`, with the other columns beside it."""
    own = {k for k, _, _ in PAGE_FIELDS} | {column}
    kept = [c for c in df.columns if c not in own]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept] + [f"{k} {t}" for k, t, _ in PAGE_FIELDS])
    return map_slices(df, lambda: lambda part: page_batch(part, column, kept), schema, column)


def payload_of(text: str, unit: int = WIDTH) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (unit * max(1, -(-len(raw) // unit)) - len(raw))


def store(payload: bytes) -> bytes:
    """A file whose pages hold the payload; the layouts follow from the payload alone."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    turn = zlib.crc32(payload)
    return write_tiff([(image[y : y + PAGE_ROWS], LAYOUTS[(turn + k) % len(LAYOUTS)]) for k, y in enumerate(range(0, len(image), PAGE_ROWS))])


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_batch(part: pa.RecordBatch) -> pa.RecordBatch:
    values = part.column("text").to_pylist()
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) for t in values], pa.int64()), pa.array([store(payload_of(t)) for t in values], pa.binary())], schema=STORED)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and media: the text's UTF-8 bytes, filled up with 255, as a TIFF file."""
    return map_slices(texts(docs, id_col, text_col), lambda: store_batch, "doc_id long, n_bytes long, media binary")


def feature_of(pixels: bytes, pages: int) -> str:
    """Pages, mean, deviation, and a 64-bit hash: whether each of 64 stretches is lighter than the whole."""
    x = np.frombuffer(pixels, np.uint8)
    mean = x.mean()
    edges = np.arange(64) * len(x) // 64
    light = np.add.reduceat(x.astype(np.int64), edges) > mean * np.diff(np.append(edges, len(x)))
    return f"{pages};{mean:.4f};{x.std():.4f};{np.packbits(light).tobytes().hex()}"


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())])


def digest_batch(part: pa.RecordBatch) -> pa.RecordBatch:
    """Stored files in, one digest row per file out, from the pages as `page_batch` decodes them."""
    files = part.column("media").to_pylist()
    at = pa.RecordBatch.from_arrays([pa.array(range(len(files)), pa.int64()), part.column("media")], names=["file", "media"])
    pages: list[list[bytes]] = [[] for _ in files]
    decoded = page_batch(at, "media", ["file"])
    for file, pixels, error in zip(decoded.column("file").to_pylist(), decoded.column("pixels").to_pylist(), decoded.column("error").to_pylist()):
        if error:
            raise TiffError(error)
        pages[file].append(pixels)
    rows = []
    for doc_id, n_bytes, media, own in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), files, pages):
        payload = b"".join(own)
        rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, len(own)), len(own)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), DIGEST.types)] if rows else [pa.array([], t) for t in DIGEST.types], schema=DIGEST)


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back page by page and digests them, all in one narrow pass."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return map_slices(texts(docs, id_col, text_col), lambda: lambda part: digest_batch(store_batch(part)), schema)
