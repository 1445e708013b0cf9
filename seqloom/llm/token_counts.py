"""Token counts by compiled transducers.

Two deterministic transducers run in cascade. The first cuts text into pretokens: its twelve states read character
classes and mark where pretokens start. A batch of texts is one sequence of characters, cut into chunks; every chunk
gets its state map (end state for each start state), all chunks in lockstep, the maps are composed by a parallel
prefix scan, and a second lockstep pass from the known start states emits the marks.

The second transducer reads the bytes of a pretoken; each transition carries the change of the number of tokens. It
is the determinised form of "tokens whose neighbours are compatible": its state holds, for each still open suffix,
the token before it, its place in the vocabulary's trie and its count. States are made when first reached, and kept up
to a bound, after which the tables start anew. Every pretoken starts in the first state, so a short one is a chunk whose
map is one count, and these are summed; a long one is cut into chunks of bytes, each with a map from start states, which
are found without the chunk before, to end state and added count, and the same scan composes these maps.

Defined results: a null text is the empty text with 0 tokens; special strings count one token each and separate the
text around them; repeated rows give repeated rows; null ids pass through; other columns are left out.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seqloom.llm.common import Memo, map_slices, texts

MODEL = "byte_bpe_50k.json"
CHUNK, WARM = 1024, 48
MAX_STATES, MAX_WORDS, LONG_WORD = 250_000, 100_000, 64
BYTES, SECTION = 128, 65_536  # of a long pretoken: in a chunk, and between looks at the number of states
SUFFIX = 96  # bytes before a chunk from which its start is guessed

# Character classes: letters without a part in contractions, numbers, other characters, the space, other white space,
# the apostrophe, letters that end a contraction at once, the letters r, v, l and e, and the end of a text.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, SHORT, R, V, LL, E, STOP = range(12)
WHITE_SPACE = "\t\n\v\f\r\x85\xa0                　"
# States: nothing open; in letters, numbers, others; after an opening apostrophe, alone or with r, v, l; in white space
# of one or more characters that ends in a space or in another character.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, MANY_SPACE, ONE_WHITE, MANY_WHITE) = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # marks: a pretoken starts at this character, or at the one before


def _tables() -> tuple[np.ndarray, np.ndarray]:
    step, mark = np.zeros((12, N_STATES), np.uint8), np.zeros((12, N_STATES), np.uint8)
    letters = {LETTER, SHORT, R, V, LL, E}
    opened = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: AFTER_QUOTE, STOP: FRESH} | dict.fromkeys(letters, IN_LETTERS)
    for c in range(12):
        for q in range(N_STATES):
            to, out = opened[c], HERE
            if q == IN_LETTERS and c in letters or q == IN_NUMBERS and c == NUMBER:
                out = 0
            elif q in (IN_OTHERS, AFTER_QUOTE) and c in (OTHER, QUOTE):
                to, out = IN_OTHERS, 0
            elif q == AFTER_QUOTE and c in (SHORT, R, V, LL):
                to, out = {SHORT: FRESH, R: QUOTE_R, V: QUOTE_V, LL: QUOTE_L}[c], 0
            elif q in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (LL if q == QUOTE_L else E):
                    to, out = FRESH, 0
                else:
                    out = BEFORE if c in letters else BEFORE | HERE
            elif q in (ONE_SPACE, MANY_SPACE, ONE_WHITE, MANY_WHITE):
                if c in (SPACE, WHITE):
                    to, out = MANY_SPACE if c == SPACE else MANY_WHITE, 0
                elif c != STOP:
                    many = BEFORE if q in (MANY_SPACE, MANY_WHITE) else 0
                    if q in (ONE_SPACE, MANY_SPACE):
                        to, out = IN_OTHERS if c == QUOTE else to, many
                    else:
                        out = many | HERE
            step[c, q], mark[c, q] = to, out
    return step, mark


STEP, MARK = _tables()


def class_table() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[ord(c) for c in WHITE_SPACE]] = WHITE
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", LL), ("e", E)):
        out[[ord(c) for c in chars]] = kind
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, chunks by states, in a logarithmic number of steps."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        gap *= 2
    return maps


def scan_counts(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for maps whose paths carry counts: where the path from each start ends, and what it adds up to. Entries are
    chunks by starts; an end is the number of a start of the next chunk."""
    gap = 1
    while gap < len(ends):
        before = ends[:-gap]
        added = np.take_along_axis(counts[gap:], before, axis=1) + counts[:-gap]
        onward = np.take_along_axis(ends[gap:], before, axis=1)
        ends, counts = np.concatenate([ends[:gap], onward]), np.concatenate([counts[:gap], added])
        gap *= 2
    return ends, counts


def marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pretokens start, for a sequence of character classes that begins fresh and ends with STOP."""
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, STOP, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    step, mark = STEP.ravel(), MARK.ravel()
    base = grid.astype(np.int16) * N_STATES
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    warm = min(WARM, chunk)
    for j in range(warm):
        maps = step[base[j][:, None] + maps]
    open_rows = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    one = maps[:, 0]
    for j in range(warm, chunk):
        one = step[base[j] + one]
    if len(open_rows):  # start states that still lead to different states
        part = maps[open_rows]
        for j in range(warm, chunk):
            part = step[base[j][open_rows][:, None] + part]
    maps[:] = one[:, None]
    if len(open_rows):
        maps[open_rows] = part
    state = np.concatenate([[FRESH], scan_maps(maps)[:-1, FRESH]]).astype(np.uint8)
    found = np.empty((chunk, rows), np.uint8)
    for j in range(chunk):
        at = base[j] + state
        found[j] = mark[at]
        state = step[at]
    flat = np.ascontiguousarray(found.T).ravel()[:n]
    here = (flat & HERE).astype(bool)
    here[:-1] |= (flat[1:] & BEFORE) > 0
    return np.flatnonzero(here)


class Merges:
    """A byte-level vocabulary: how tokens merge, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.tokens = [bytes([i]) for i in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right, self.merged = [-1] * 256, [-1] * 256, {}
        for pair in model["model"]["merges"]:
            a, b = (bytes(byte_of[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = number.setdefault(a + b, len(self.tokens))
            if whole == len(self.tokens):
                self.tokens.append(a + b)
                self.left.append(number[a])
                self.right.append(number[b])
            self.merged.setdefault((number[a], number[b]), whole)
        self.ids = [-1] * len(self.tokens)  # by number: the id in the vocabulary
        for shown_as, i in model["model"]["vocab"].items():
            if shown_as not in self.special:
                self.ids[number[bytes(byte_of[c] for c in shown_as)]] = i
        self.known: dict[tuple[int, int], bool] = {}

    def stay(self, a: int, b: int, bound: int) -> bool:
        """Whether the two tokens, side by side, stay as they are under the merges below `bound`, applied in order: their own
        merges are undone from the latest on, looking for an earlier merge across."""
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and whole < bound:
                return False
            if a > b and self.right[a] >= 0:
                bound, a = a, self.right[a]
            elif self.left[b] >= 0:
                bound, b = b + 1, self.left[b]
            elif self.right[a] >= 0:
                bound, a = a, self.right[a]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, stay as they are when the merges are applied in order."""
        if (got := self.known.get((a, b))) is None:
            got = self.known[a, b] = self.stay(a, b, len(self.tokens))
        return got


class Counter:
    """Counts the tokens of pretokens by running the byte transducer; known pretokens are kept."""

    def __init__(self, merges: Merges):
        self.words = Memo(self.count, MAX_WORDS)
        self.merges = merges
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for i, token in enumerate(merges.tokens):
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.inner = frozenset(key >> 8 for key in self.child)
        self._start()

    def _start(self) -> None:
        # An open suffix is one number: the token before it (0: none) plus 1, its trie node, and its count relative to the
        # whole, which lies within the longest token's length.
        self.items = [(self._item(-1, 0, 0),)]
        self.number = {self.items[0]: 0}
        self.moves: dict[int, int] = {}
        self.merges.known.clear()

    @staticmethod
    def _item(before: int, node: int, rel: int) -> int:
        return (before + 1) << 40 | node << 16 | (rel + 32768)

    def _move(self, state: int, byte: int) -> int:
        """The transition: next state and the change of the count, as one number."""
        token_at, child, inner, alive, token, count = self.token_at, self.child, self.inner, [], -1, 0
        for item in self.items[state]:
            at = child.get((item >> 16 & 0xFFFFFF) << 8 | byte)
            if at is None:
                continue
            before, rel = (item >> 40) - 1, (item & 0xFFFF) - 32768
            if at in inner:  # else no token goes on from here
                alive.append((before, at, rel))
            whole = token_at[at]
            if token < 0 and whole >= 0 and (before < 0 or self.merges.compatible(before, whole)):
                token, count = whole, rel + 1
        items = (*[self._item(before, at, rel - count) for before, at, rel in alive], self._item(token, 0, 0))
        to = self.number.setdefault(items, len(self.items))
        if to == len(self.items):
            self.items.append(items)
        self.moves[state << 8 | byte] = out = to << 16 | (count + 32768)
        return out

    def _walk(self, state: int, data: bytes) -> tuple[int, int]:
        """Where the path over these bytes ends, and the tokens that it adds."""
        total, known = 0, self.moves.get
        for byte in data:
            got = known(state << 8 | byte)
            if got is None:
                got = self._move(state, byte)
            state = got >> 16
            total += (got & 0xFFFF) - 32768
        return state, total

    def count(self, word: str) -> int:
        if len(self.items) > MAX_STATES:
            self._start()
        return self._walk(0, word.encode())[1]

    def count_long(self, word: str) -> int:
        """The same by chunks. A section keeps the number of states bounded whatever the length; its last state goes on
        by what it holds, as numbers of states end when the tables start anew."""
        data, items, total = word.encode(), self.items[0], 0
        for at in range(0, len(data), SECTION):
            if len(self.items) > MAX_STATES:
                self._start()
            state = self.number.setdefault(items, len(self.items))
            if state == len(self.items):
                self.items.append(items)
            state, added = self._section(state, data[at : at + SECTION])
            items, total = self.items[state], total + added
        return total

    def _section(self, first: int, data: bytes) -> tuple[int, int]:
        """Maps of the chunks, composed. A chunk's start is not taken from the chunk before it, but is the state after the
        bytes before it, begun as if they began a pretoken; paths meet within a token or two. Where a chunk's path ends
        in a state that the next chunk does not start from, that start is added, until the maps are closed; then the
        scan composes them. Equal chunks share their paths."""
        chunks = [data[at : at + BYTES] for at in range(0, len(data), BYTES)]
        starts = [{first: 0}] + [{self._walk(0, data[max(i * BYTES - SUFFIX, 0) : i * BYTES])[0]: 0} for i in range(1, len(chunks))] + [{}]
        walked: dict[tuple[int, bytes], tuple[int, int]] = {}
        maps: list[list[tuple[int, int]]] = [[] for _ in chunks]
        open_ = list(range(len(chunks)))
        while open_:
            again = []
            for i in open_:
                for state in list(starts[i])[len(maps[i]) :]:
                    path = walked.get((state, chunks[i]))
                    if path is None:
                        path = walked[state, chunks[i]] = self._walk(state, chunks[i])
                    if path[0] not in starts[i + 1]:
                        starts[i + 1][path[0]] = len(starts[i + 1])
                        if i + 1 < len(chunks):
                            again.append(i + 1)
                    maps[i].append((starts[i + 1][path[0]], path[1]))
            open_ = again
        table = np.zeros((len(maps), max(map(len, starts)), 2), np.int64)
        for i, row in enumerate(maps):
            table[i, : len(row)] = row
        ends, counts = scan_counts(table[..., 0], table[..., 1])
        return list(starts[-1])[ends[-1, 0]], int(counts[-1, 0])


_LOADED: dict[str, tuple] = {}


def loaded(path: str) -> tuple[np.ndarray, Counter]:
    if path not in _LOADED:
        _LOADED[path] = (class_table(), Counter(Merges(path)))
    return _LOADED[path]


def pretokens(values: list[str], table: np.ndarray, special: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    """The pretokens of all texts in one list. Texts are cut at special strings into parts, and each part ends in an entry that
    is no pretoken: its place, for each part; the first part of each text; and the id of the special string that ends the
    part (-1: the end of the text)."""
    parts, first, ended = [], [], []
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    for text in values:
        first.append(len(parts))
        own = cut.split(text) if cut else [text]
        parts += own[::2]
        ended += [*[special[x] for x in own[1::2]], -1]
    whole = "\n".join(parts) + "\n"
    classes = table[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    classes[ends] = STOP
    starts = marks(classes)
    at = starts.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])] + [""], np.searchsorted(starts, ends), np.array(first), ended


def count_tokens(values: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    table, counter = loaded(path)
    if not values:
        return np.zeros(0, np.int64)
    words, stops, first, ended = pretokens(values, table, counter.merges.special)
    if max(map(len, words)) > LONG_WORD:  # long pretokens are not kept
        counts = np.array([counter.words[w] if len(w) <= LONG_WORD else counter.count_long(w) for w in words], np.int64)
    else:
        counts = np.fromiter(map(counter.words.__getitem__, words), np.int64, len(words))
    counts[stops] = np.array(ended) >= 0  # a special string is one token
    begin = np.concatenate([[0], stops[:-1] + 1])
    return np.add.reduceat(counts, begin[first])


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each text, for the byte-level vocabulary in the file `path`."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("text")
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(column).cast(pa.int64()), pa.array(count_tokens(column.to_pylist(), path))], schema=OUT)

    return map_slices(texts(docs, id_col, text_col), lambda: run, "doc_id long, n_bytes long, n_tokens long")
