"""TIFF: exact round trips, other layouts and broken files."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from seqloom.llm import tiff


def noisy(n, seed=0):
    rng = random.Random(seed)
    return bytes(rng.choice((0, 0, 0, 7, 255, rng.randrange(256))) for _ in range(n))


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 1000, noisy(5000), bytes(range(256)) * 40, noisy(70_000, 3)])
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("layout", tiff.LAYOUTS)
@pytest.mark.parametrize("shape", [(1, 576), (40, 576), (33, 200)])
def test_layouts(layout, shape):
    image = np.frombuffer(noisy(shape[0] * shape[1]), np.uint8).reshape(shape)
    pages = list(tiff.read_pages(tiff.write_tiff([(image, layout), (image[:1], layout)])))
    assert [p["error"] for p in pages] == [None, None] and [p["page_no"] for p in pages] == [0, 1]
    assert pages[0]["pixels"] == image.tobytes() and pages[1]["pixels"] == image[:1].tobytes()
    assert (pages[0]["width"], pages[0]["height"], pages[0]["compression"]) == (shape[1], shape[0], layout[0])


def big_endian_rgb(planar):
    x = np.arange(2 * 3 * 3, dtype=np.uint16).reshape(2, 3, 3) * 300
    planes = [x[:, :, i].astype(">u2").tobytes() for i in range(3)] if planar == 2 else [x.astype(">u2").tobytes()]
    out, at = b"MM\0\x2a" + b"\0" * 4, []
    for p in planes:
        at.append(len(out))
        out += p
    lists = len(out)
    out += struct.pack(f">{len(at)}I", *at) + struct.pack(f">{len(at)}I", *map(len, planes))
    tags = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (277, 3, 1, 3 << 16), (284, 3, 1, planar << 16)]
    tags += [(273, 4, len(at), lists if len(at) > 1 else at[0]), (279, 4, len(at), lists + 4 * len(at) if len(at) > 1 else len(planes[0]))]
    start = len(out)
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in sorted(tags)) + struct.pack(">I", start)  # the chain loops
    return out[:4] + struct.pack(">I", start) + out[8:], x


@pytest.mark.parametrize("planar", [1, 2])
def test_big_endian_samples_and_loops(planar):
    data, x = big_endian_rgb(planar)
    pages = list(tiff.read_pages(data))
    assert len(pages) == 1 and pages[0]["error"] is None and pages[0]["pixels"] == x.tobytes()


def test_broken_files():
    assert [p["page_no"] for p in tiff.read_pages(None)] == [-1]
    assert next(tiff.read_pages(b"hello"))["error"]
    good = bytearray(tiff.store(tiff.payload_of("x" * 3000)))
    assert all(p["error"] for p in tiff.read_pages(bytes(good[:40])))
    image = np.zeros((4, 576), np.uint8)
    cut = tiff.write_tiff([(image, (tiff.ADOBE_DEFLATE, 1, False)), (image, (tiff.NONE, 1, False))]).replace(zlib.compress(image.tobytes(), 1)[:6], b"\0" * 6)
    pages = list(tiff.read_pages(cut))
    assert pages[0]["error"] and pages[0]["pixels"] is None and pages[1]["error"] is None


def test_query_digests(spark):
    rows = [(1, None, "clash"), (2, "", "x"), (3, "a", "x"), (4, "é" * 9000, "x"), (5, "a", "x"), (None, "ab\n" * 40_000, "x"), (5, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = tiff.text_media_digest(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = by[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by[3].media_sha256 == by[5].media_sha256 and by[3].feature == by[5].feature and by[1].feature == by[2].feature
    pages = tiff.tiff_pages(tiff.store_texts(df))
    assert pages.where("doc_id is null").count() == math.ceil(math.ceil(120_000 / 576) / 128)
    assert tiff.text_media_digest(df.limit(0)).count() == 0 and tiff.tiff_pages(spark.createDataFrame([(b"x", 1)], "media binary, page_no int")).first().page_no == -1


def test_sizes_are_checked_before_memory_is_taken():
    """A hundred bytes that claim 2^20 x 2^20 samples, or strips of that size, are an error row."""
    import struct
    import time

    def file(**tags):
        own = sorted({256: 1 << 20, 257: 1 << 20, 258: 8, 259: 1, 273: 8, 277: 1, 278: 1 << 20, 279: 4, **{int(k[1:]): v for k, v in tags.items()}}.items())
        body = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in own)
        return struct.pack("<2sHI", b"II", 42, 12) + b"abcd" + struct.pack("<H", len(own)) + body + struct.pack("<I", 0)

    began = time.time()
    for data in (file(), file(_278=1), file(_259=8), file(_259=5), file(_257=1, _322=1 << 30, _323=1 << 30, _324=8, _325=4), file(_277=1 << 30, _284=2)):
        rows = list(tiff.read_pages(data))
        assert len(rows) == 1 and rows[0]["error"] and rows[0]["pixels"] is None
    assert time.time() - began < 2


def one_strip(image, order="<", kind=tiff.NONE, stored=None, **tags):
    """A file of one strip (rows by columns by samples) and further tags, _<number>=value."""
    height, width, samples = image.shape
    raw = image.astype(image.dtype.newbyteorder(order)).tobytes() if stored is None else stored
    own = {256: width, 257: height, 258: image.dtype.itemsize * 8, 259: kind, 273: 8, 277: samples, 278: height, 279: len(raw)} | {int(k[1:]): v for k, v in tags.items()}
    body = b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in sorted(own.items()))
    start = 8 + len(raw) + len(raw) % 2
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, start) + raw + b"\0" * (len(raw) % 2) + struct.pack(order + "H", len(own)) + body + struct.pack(order + "I", 0)


def decoded(data, dtype, shape):
    (page,) = tiff.read_pages(data)
    assert page["error"] is None, page["error"]
    return np.frombuffer(page["pixels"], dtype).reshape(shape)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype,numbers", [("u1", 1), ("u2", 1), ("u4", 1), ("u8", 1), ("i1", 2), ("i2", 2), ("i4", 2), ("f2", 3), ("f4", 3), ("f8", 3)])
def test_kinds_of_samples(order, dtype, numbers):
    x = (np.random.default_rng(1).normal(size=(5, 7, 3)) * 90).astype(dtype)
    assert (decoded(one_strip(x, order, _339=numbers), dtype, x.shape) == x).all()
    bits = x.view(f"u{x.itemsize}")
    apart = np.concatenate([bits[:, :1], np.diff(bits, axis=1)], axis=1)
    assert (decoded(one_strip(apart, order, _339=numbers, _317=2), dtype, x.shape) == x).all()
    stored = zlib.compress(x.astype(x.dtype.newbyteorder(order)).tobytes())
    assert (decoded(one_strip(x, order, tiff.ADOBE_DEFLATE, stored, _339=numbers), dtype, x.shape) == x).all()


@pytest.mark.parametrize("dtype", ["f2", "f4", "f8"])
@pytest.mark.parametrize("order", ["<", ">"])
def test_floating_point_predictor(dtype, order):
    """By the rule itself: a row's bytes by significance, and each less the one `samples` before it."""
    x = np.random.default_rng(2).normal(size=(4, 6, 2)).astype(dtype)
    rows = []
    for row in x.astype(x.dtype.newbyteorder(">")):
        raw = row.tobytes()
        planes = b"".join(raw[i :: x.itemsize] for i in range(x.itemsize))
        rows.append(bytes((planes[i] - (planes[i - 2] if i >= 2 else 0)) % 256 for i in range(len(planes))))
    assert (decoded(one_strip(x, order, stored=b"".join(rows), _317=3, _339=3), dtype, x.shape) == x).all()
    (page,) = tiff.read_pages(one_strip(x.view(f"u{x.itemsize}"), order, _317=3))
    assert page["error"] and page["pixels"] is None


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("mirrored", [False, True])
def test_samples_below_a_byte(bits, mirrored):
    """Rows begin at whole bytes; in the other order of bits the lowest comes first."""
    x = np.random.default_rng(bits).integers(0, 1 << bits, (5, 11, 3), dtype=np.uint8)
    raw = b""
    for row in x:
        line = "".join(f"{v:0{bits}b}" for v in row.ravel())
        line += "0" * (-len(line) % 8)
        raw += bytes(int(line[i : i + 8][::-1] if mirrored else line[i : i + 8], 2) for i in range(0, len(line), 8))
    assert (decoded(one_strip(x, stored=raw, _258=bits, _266=2 if mirrored else 1), np.uint8, x.shape) == x).all()


def test_order_of_bits_of_compressed_strips():
    x = np.frombuffer(noisy(600), np.uint8).reshape(10, 60, 1)
    for kind, stored in ((tiff.LZW, tiff.lzw_encode(x.tobytes())), (tiff.PACKBITS, tiff.packbits_encode(x.tobytes())), (tiff.DEFLATE, zlib.compress(x.tobytes()))):
        mirrored = bytes(int(f"{b:08b}"[::-1], 2) for b in stored)
        assert (decoded(one_strip(x, kind=kind, stored=mirrored, _266=2), np.uint8, x.shape) == x).all()


def test_sub_directories():
    """Two pages; the first has two smaller ones below it, the second of which has one more."""
    out, places = bytearray(b"II*\0\0\0\0\0"), {}

    def directory(name, value, links, following):
        strip = len(out)
        out.extend(bytes([value]) * 4)
        at = 0
        if len(links) > 1:
            at = len(out)
            out.extend(struct.pack(f"<{len(links)}I", *links))
        own = {256: (4, 1, 2), 257: (4, 1, 2), 258: (4, 1, 8), 259: (4, 1, 1), 273: (4, 1, strip), 277: (4, 1, 1), 278: (4, 1, 2), 279: (4, 1, 4)}
        if links:
            own[330] = (13, len(links), at if at else links[0])
        places[name] = len(out)
        out.extend(struct.pack("<H", len(own)) + b"".join(struct.pack("<HHII", t, *v) for t, v in sorted(own.items())) + struct.pack("<I", following))

    directory("lowest", 4, [], 0)
    directory("second", 3, [places["lowest"], places["lowest"]], 0)  # named twice: one page
    directory("first", 2, [], 0)
    directory("last", 5, [], 0)
    directory("main", 1, [places["first"], places["second"]], places["last"])
    struct.pack_into("<I", out, 4, places["main"])
    pages = list(tiff.read_pages(bytes(out)))
    assert [(p["page_no"], p["parent"], p["pixels"][0], p["error"]) for p in pages] == [(0, None, 1, None), (1, 0, 2, None), (2, 0, 3, None), (3, 2, 4, None), (4, None, 5, None)]
