"""Encoding and decoding with a merge-type piece vocabulary, by backtracking.

The longest pieces at each place come from one Aho-Corasick pass over a word. Pieces are tried longest first; a piece
stands if the place after it has not failed before (a bitfield holds the failed places) and if re-merging it with the
piece before it gives the same two pieces. A place without a piece left is marked as failed, and the piece before it
is shortened. Characters without a piece become byte pieces.

A text is cut into words only where no piece of the vocabulary can reach across, so whole texts are encoded exactly;
known words are kept up to a bound.

Defined results: a null text is the empty text, with no ids; repeated rows give repeated rows; null ids pass through;
other columns are left out; ids that the vocabulary lacks raise an IndexError on decoding.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.common import Memo, map_slices, texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MAX_WORDS, MAX_PAIRS, LONG_WORD = 100_000, 250_000, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """The fields of a protocol-buffer message: number and value."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> list[tuple[str, int, float]]:
    """Pieces, their kinds and scores, by id. Only merge models without a character map and with byte pieces are taken."""
    pieces, kind, mapped = [], 1, b""
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), own.get(3, NORMAL), struct.unpack("<f", own.get(2, bytes(4)))[0]))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                mapped = dict(_fields(value)).get(2, b"")
    if kind != 2 or mapped or sum(k == BYTE for _, k, _ in pieces) != 256:
        raise ValueError("not a merge model with byte pieces and without a character map")
    return pieces


class Pieces:
    def __init__(self, path: str):
        self.pieces = read_model(path)
        self.id_of = {p: i for i, (p, k, _) in enumerate(self.pieces) if k == NORMAL}
        order = {s: r for r, s in enumerate(sorted({s for _, k, s in self.pieces if k == NORMAL}, reverse=True))}
        self.rank = {p: order[s] for p, k, s in self.pieces if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k, _) in enumerate(self.pieces) if k == BYTE}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.machine = ahocorasick.Automaton()
        inside = set()
        for piece in self.id_of:
            inside.update(pairwise(piece))
            if self.parts(piece) != ("", ""):  # pieces that merging can give
                self.machine.add_word(piece, (len(piece), piece))
        self.machine.make_automaton()
        # Words end where a space begins, and between word characters and others as far as no piece has such a pair inside.
        if any(b == SPACE != a for a, b in inside):
            raise ValueError("a piece has a space after other characters")
        word, apart = re.compile(r"\w").match, set()
        while crossing := {c for a, b in inside if a != SPACE and (x := bool(word(a)) and a not in apart) != (bool(word(b)) and b not in apart) for c in (a if x else b)}:
            apart |= crossing
        cut = re.escape("".join(sorted(apart)))
        self.split = re.compile(rf"{SPACE}*[^\W{cut}]+|{SPACE}*(?:(?!{SPACE})[\W{cut}])+|{SPACE}+")
        self.words = Memo(self.word, MAX_WORDS)

    def merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Merges the best pair, leftmost first, until none is left; also the last pair merged."""
        last = None
        while True:
            best = min(((r, i) for i, (a, b) in enumerate(pairwise(symbols)) if (r := self.rank.get(a + b)) is not None), default=None)
            if best is None:
                return symbols, last
            i = best[1]
            last = (symbols[i], symbols[i + 1])
            symbols = symbols[:i] + ["".join(last)] + symbols[i + 2 :]

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives this one last; None for a character; ("", "") if merging never gives it."""
        if piece not in self.halves:
            symbols, last = self.merge(list(piece))
            self.halves[piece] = None if len(piece) == 1 else last if symbols == [piece] else ("", "")
        return self.halves[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether two pieces side by side stay so: their merges are undone from the latest on, looking for an earlier merge across."""
        key, rank, halves = (a, b), self.rank, self.halves
        bound, out = len(self.pieces), True
        while True:
            across = rank.get(a + b)
            if across is not None and across < bound:
                out = False
                break
            left = halves[a] if a in halves else self.parts(a)
            right = halves[b] if b in halves else self.parts(b)
            if left and (not right or rank[a] > rank[b]):
                bound, a = rank[a], left[1]
            elif right:
                bound, b = rank[b] + 1, right[0]
            else:
                break
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        n, pairs = len(word), self.pairs
        at_place: list[list[str]] = [[c] for c in word]
        for end, (size, piece) in self.machine.iter(word):
            if size > 1:
                at_place[end + 1 - size].append(piece)
        out: list[str] = []
        tried: list[int] = []  # by piece of `out`: its index among the pieces of its place
        failed, place, last = bytearray(n // 8 + 1), 0, ""  # failed: a bit for each place
        choice = len(at_place[0]) - 1
        while place < n:
            here = at_place[place]
            while choice >= 0:
                piece = here[choice]
                end = place + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not last:
                        break
                    fits = pairs.get((last, piece))
                    if self.compatible(last, piece) if fits is None else fits:
                        break
                choice -= 1
            if choice >= 0:
                out.append(piece)
                tried.append(choice)
                place = end
                last = piece
                if place < n:
                    choice = len(at_place[place]) - 1
            elif not out:
                raise ValueError(f"no encoding of {word!r}")
            else:
                failed[place >> 3] |= 1 << (place & 7)
                place -= len(out.pop())
                choice = tried.pop() - 1
                last = out[-1] if out else ""
        ids: list[int] = []
        for piece in out:
            i = self.id_of.get(piece)
            if i is not None:
                ids.append(i)
            else:
                ids.extend([self.byte_id[b] for b in piece.encode()])
        return ids

    def word(self, word: str) -> tuple[int, str, str]:
        """The number of ids, the ids as text, and the text that they decode to."""
        ids = self.encode_word(word)
        return len(ids), ",".join(map(str, ids)), self.decode_ids(ids)

    def words_of(self, text: str) -> list[str]:
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words_of(text) for i in self.encode_word(word)]

    def decode_ids(self, ids: list[int]) -> str:
        """The pieces' text with spaces, bytes joined; the first space still stands."""
        out, held = [], bytearray()
        for i in ids:
            piece, kind, _ = self.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else piece.replace(SPACE, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_text(model: Pieces, text: str) -> tuple[int, str, str]:
    """The number of ids, the ids joined by commas, and the decoded text."""
    words = model.words_of(text)
    if max(map(len, words), default=0) > LONG_WORD:  # long words are not kept
        own = [model.words[w] if len(w) <= LONG_WORD else model.word(w) for w in words]
    else:
        own = list(map(model.words.__getitem__, words))
    return sum([w[0] for w in own]), ",".join([w[1] for w in own]), "".join([w[2] for w in own]).removeprefix(" ")


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text; digests of the ids (decimal, joined by commas) and of the decoded text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(path)
        rows = [encode_text(model, t) for t in part.column("text").to_pylist()]
        sha = lambda i: pa.array([hashlib.sha256(r[i].encode()).hexdigest() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), sha(1), sha(2)], schema=OUT)

    return map_slices(texts(docs, id_col, text_col), lambda: run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids: the ids of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(path)
        ids = [[int(i) for i in encode_text(model, t)[1].split(",") if i] for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return map_slices(texts(docs, id_col, text_col), lambda: run, "doc_id long, ids array<int>")


def decode_pieces(df: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text: what the ids decode to (null ids: the empty text)."""

    def run(batches):
        model = loaded(path)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.decode(i or []) for i in part.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{ids_col}` as array<int>) as ids").mapInArrow(run, "doc_id long, text string")
