"""Encoding and decoding with a byte-level merge vocabulary, by backtracking.

One Aho-Corasick pass over the reversed bytes of a pretoken gives the longest token that begins at each place. From left to
right, the longest token is tried first, then its longest prefix that is a token, and so on. A token stands if the place
after it has not failed before (a bitfield holds the failed places) and if the pair table says that it can stand beside
the token before it; entries of the table are made when first asked for, by undoing merges, and kept up to a bound. A
place without a token left fails, and the token before it is shortened. A place fails once, so the work is linear.

Decoding takes each id's bytes from one string of all tokens by a table of offsets.

Pretokens and special strings are as `token_counts` cuts them. Defined results: a null text is the empty text, with no ids;
special strings become their ids; repeated rows give repeated rows; null ids pass through; other columns are left out;
null ids' lists decode to the empty text; ids that the vocabulary lacks raise an IndexError on decoding.
"""

from __future__ import annotations

import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.common import Memo, map_slices, texts
from seqloom.llm.token_counts import LONG_WORD, MODEL, Merges, class_table, pretokens  # noqa: F401  (the model's name is used by queries)

MAX_WORDS, MAX_PAIRS = 100_000, 250_000
#: Ids that are decoded at once.
PIECE = 1 << 18


class BytePairs:
    def __init__(self, path: str):
        self.merges = m = Merges(path)
        self.classes = class_table()
        number = {t: i for i, t in enumerate(m.tokens)}
        # Tokens that merging can give: both parts can be had, and nothing across them merges before.
        reached = [True] * 256
        for t in range(256, len(m.tokens)):
            reached.append(reached[m.left[t]] and reached[m.right[t]] and m.stay(m.left[t], m.right[t], t))
        self.size = list(map(len, m.tokens))
        self.shorter = [next((p for n in range(len(t) - 1, 0, -1) if (p := number.get(t[:n], -1)) >= 0 and reached[p]), -1) for t in m.tokens]
        self.machine = ahocorasick.Automaton()
        for i, token in enumerate(m.tokens):
            if reached[i]:
                self.machine.add_word(token[::-1].decode("latin-1"), i)
        self.machine.make_automaton()
        bound = len(m.tokens)
        self.pairs = Memo(lambda key: m.stay(key >> 32, key & 0xFFFFFFFF, bound), MAX_PAIRS)
        self.words = Memo(self.word, MAX_WORDS)
        by_id = {i: t for i, t in zip(m.ids, m.tokens) if i >= 0} | {i: s.encode() for s, i in m.special.items()}
        every = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in every])])
        self.bytes = np.frombuffer(b"".join(every), np.uint8)
        self.known = np.array([i in by_id for i in range(len(every))])

    def tokens(self, data: bytes) -> array:
        """The numbers of the tokens of a pretoken's bytes."""
        n, size, shorter, pairs = len(data), self.size, self.shorter, self.pairs
        longest, last = array("i", bytes(4 * n)), -1
        for end, token in self.machine.iter(data[::-1].decode("latin-1")):
            if end != last:  # the first match that ends at a place is the longest
                longest[n - 1 - end] = token
                last = end
        out, failed = array("i"), bytearray(n // 8 + 1)  # failed: a bit for each place
        place, before = 0, -1
        token = longest[0] if n else -1
        while place < n:
            while token >= 0:
                end = place + size[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (before < 0 or pairs[before << 32 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before, place = token, end
                token = longest[place] if place < n else -1
            elif out:
                failed[place >> 3] |= 1 << (place & 7)
                token = out.pop()
                place -= size[token]
                token, before = shorter[token], out[-1] if out else -1
            else:
                raise ValueError(f"no encoding of {data!r}")
        return out

    def word(self, word: str) -> bytes:
        """The ids of a pretoken as little-endian unsigned numbers of 32 bits."""
        ids = self.merges.ids
        return np.array([ids[t] for t in self.tokens(word.encode())], "<u4").tobytes()

    def encode(self, values: list[str]) -> list[bytes]:
        """The ids of each text, as in `word`."""
        if not values:
            return []
        words, stops, first, ended = pretokens(values, self.classes, self.merges.special)
        if max(map(len, words)) > LONG_WORD:  # long pretokens are not kept
            ids = [self.words[w] if len(w) <= LONG_WORD else self.word(w) for w in words]
        else:
            ids = list(map(self.words.__getitem__, words))
        for stop, special in zip(stops.tolist(), ended):
            ids[stop] = b"" if special < 0 else special.to_bytes(4, "little")
        begin = np.concatenate([[0], stops + 1])[np.append(first, len(stops))].tolist()
        return [b"".join(ids[a:b]) for a, b in zip(begin, begin[1:])]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise IndexError("an id is not in the vocabulary")
        out = []
        for at in range(0, len(ids), PIECE):
            own = ids[at : at + PIECE]
            start, size = self.offsets[own], self.offsets[own + 1] - self.offsets[own]
            out.append(self.bytes[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text; digests of the ids (little-endian, 32 bits) and of the decoded text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(path)
        ids = model.encode(part.column("text").to_pylist())
        sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
        decoded = (model.decode(np.frombuffer(i, "<u4")).encode() for i in ids)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), sha(ids), sha(decoded)], schema=OUT)

    return map_slices(texts(docs, id_col, text_col), lambda: run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_bytes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids: the ids of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = loaded(path).encode(part.column("text").to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema)

    return map_slices(texts(docs, id_col, text_col), lambda: run, "doc_id long, ids array<int>")


def decode_bytes(df: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text: what the ids decode to (null: the empty text)."""

    def run(batches):
        model = loaded(path)
        for part in batches:
            values = [model.decode(i or []) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.string())], names=["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{ids_col}` as array<int>) as ids").mapInArrow(run, "doc_id long, text string")
