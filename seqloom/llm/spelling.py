"""Groups of spelling variants: words that differ by one inserted, deleted or replaced character.

Words are counted in the task that holds the text; a task returns its counts by word.

A word is cut into two halves. One edit leaves one of them as it is, so every near word that is not shorter holds the
first half at its start or the second at its end. Shards of the words' halves become Aho-Corasick automata: all words are
scanned, a match counts if it lies at the start (first half) or the end (second half) and if the length is the
owner's or one more, and what is left of both words is compared. Which shards a word has to visit follows from its
first and last characters: the owners of a shard have lengths of one class, and the least length's half of their
first (or last) characters is the shard's key. Keys with many owners are cut into blocks, and each of their words visits
every block, so no task holds more than a block of owners. Where many words share a half, what is left of them is cut into
halves again, so that not all pairs of such a group are compared.

A task returns a row a word and shard: the number of near words, and the most frequent of them. A near pair that both halves
find counts once.

Defined results: null and empty texts have no words; a null id stands as an empty string in the planting of errors;
repeated rows count again; other columns are left out; an empty table gives no rows; ties of frequency go to the
smaller word in code-point order; words without a form are their own root.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, texts

MIN_LENGTH, MIN_COUNT, RATIO, PLANTED = 5, 3, 2, 97
#: The least lengths of the classes; half of it is the length of a shard's key.
CLASSES = (5, 6, 8, 10, 12, 16, 24, 48)
#: Owners in a block of a key; rows that a task scans at once; distinct words that a task counts before it returns them.
BLOCK, SCAN, HELD = 4_000, 50_000, 200_000
#: Pairs of a group sharing a half that are compared directly; larger groups are cut further.
DIRECT = 4_096
#: Pairs that are compared at once, and the length from which words are compared one by one.
COMPARED, WIDE = 1 << 17, 48

# In Latin-1 a character is a byte: small letters stay, A-Z become small, all else separates.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def planted(text: str, start: int) -> Iterator[tuple[bytes, int]]:
    """The words of a text (Latin-1) with their numbers; `start` is the checksum of the id and a colon."""
    for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % PLANTED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in planted(text, zlib.crc32(f"{'' if doc is None else doc}:".encode())):
                    if len(word) >= min_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    return texts(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def class_of(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(length >= least, i).otherwise(out) if i else out
    return out


def visits(words: DataFrame) -> DataFrame:
    """Rows (side, key, block, scans, word, n): each word as an owner in the block of its own keys that it falls into, and as a
    scanner in every block of the keys at which its near words of the same length or one less can be."""
    half = F.element_at(F.array(*[F.lit(c // 2) for c in CLASSES]), F.col("class") + 1)
    key = F.concat_ws(" ", F.col("class").cast("string"), F.when(F.col("side") == "^", F.substr("word", F.lit(1), half)).otherwise(F.right("word", half)))
    own, less = class_of(F.length("word")), class_of(F.length("word") - 1)
    role = lambda scans, kind: F.struct(F.lit(scans).alias("scans"), kind.alias("class"))
    roles = F.array_compact(F.array(role(0, own), role(1, own), F.when(own != less, role(1, less))))
    each = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.scans", "r.class", F.explode(F.array(F.lit("^"), F.lit("$"))).alias("side"))
    keyed = each.select("side", key.alias("key"), "scans", "word", "n")
    many = keyed.where("scans = 0").groupBy("side", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.when(F.col("scans") == 0, F.array(F.pmod(F.xxhash64("word"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    return keyed.join(many, ["side", "key"], "left").select("side", "key", F.explode(mine).alias("block"), "scans", "word", "n")


def groups_to_compare(a: list[int], b: list[int], words: list[str], begin: int, end: int, left: int) -> Iterator[tuple[list[int], list[int]]]:
    """Groups that hold every near pair of a word of a and one of b, words that share their first `begin` and last `end`
    characters. `left` characters remain of each word in a; those in b have the same length or one more."""
    if len(a) * len(b) <= DIRECT or left < 2:
        yield a, b
        return
    # One of the halves of what is left of the first word stays as it is: at the start of the other's, or at its end.
    first = left // 2
    for kept, side in ((first, "^"), (left - first, "$")):
        here: dict[str, list[int]] = {}
        there: dict[str, list[int]] = {}
        for into, own in ((here, a), (there, b)):
            for i in own:
                at = begin if side == "^" else len(words[i]) - end - kept
                into.setdefault(words[i][at : at + kept], []).append(i)
        for piece in here.keys() & there.keys():
            yield from groups_to_compare(here[piece], there[piece], words, begin + (kept if side == "^" else 0), end + (kept if side == "$" else 0), left - kept)


def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b, which is as long or one character longer, by exactly one edit."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) and a != b else len(a) + 1 == len(b) and a[at:] == b[at + 1 :]


def one_edits(x: np.ndarray, y: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for many pairs of words; code: words by characters, padded with zeros."""
    a, b, n, grown = code[x], code[y], size[x], size[y] - size[x]
    head = np.minimum(np.logical_and.accumulate(a == b, axis=1).sum(axis=1), n)
    # The characters after the edit, as many as remain of the first word.
    place = np.arange(code.shape[1])[None, :]
    shifted = np.where(grown[:, None] == 1, np.pad(b, ((0, 0), (0, 1)))[:, 1:], b)
    after = place >= (head + (grown == 0))[:, None]
    rest = ((a == shifted) | ~after | (place >= n[:, None])).all(axis=1)
    return rest & np.where(grown == 0, head < n, grown == 1)


class Shard:
    """Owners and scanners of some blocks of keys of one side, or of a part of one block's scanners."""

    def __init__(self, side: str) -> None:
        self.side = side
        self.words: list[str] = []
        self.counts: list[int] = []
        self.visits: list[int] = []  # by entry: the number of its block
        self.owners: list[int] = []
        self.scanners: list[int] = []
        self.visit, self.opened = -1, 0  # the last block, and where its owners begin

    def open(self) -> None:
        self.visit, self.opened = self.visit + 1, len(self.owners)

    def add(self, word: str, n: int, scans: int) -> None:
        (self.scanners if scans else self.owners).append(len(self.words))
        self.words.append(word)
        self.counts.append(n)
        self.visits.append(self.visit)

    def onward(self) -> Shard:
        """A shard for more scanners of the last block."""
        out = Shard(self.side)
        out.open()
        for i in self.owners[self.opened :]:
            out.add(self.words[i], self.counts[i], 0)
        return out

    def matches(self) -> Iterator[tuple[list[int], list[int], str, int]]:
        """Owners and scanners that share a half, the half, and the owners' length."""
        words, side, machine = self.words, self.side, ahocorasick.Automaton()
        owners: dict[tuple[str, int, int], list[int]] = {}
        for i in self.owners:
            w = words[i]
            owners.setdefault((w[: len(w) // 2] if side == "^" else w[len(w) // 2 :], len(w), self.visits[i]), []).append(i)
        halves: dict[str, list[tuple[int, int]]] = {}
        for half, length, visit in owners:
            halves.setdefault(half, []).append((length, visit))
        if not halves:
            return
        for half, own in halves.items():
            machine.add_word(half, (half, own))
        machine.make_automaton()
        met: dict[tuple[str, int, int], list[int]] = {}
        for i in self.scanners:
            n, visit = len(words[i]), self.visits[i]
            for end, (half, own) in machine.iter(words[i]):
                if end + 1 == (len(half) if side == "^" else n):  # the half's offset fits
                    for key in own:
                        if key[1] == visit and 0 <= n - key[0] <= 1:  # and so do the block and the length
                            met.setdefault((half, *key), []).append(i)
        for key, scanners in met.items():
            yield owners[key], scanners, key[0], key[1]

    def pairs(self) -> list[tuple[int, int]]:
        """Near pairs: owner and scanner, the shorter first, or the smaller of equal length."""
        words, side = self.words, self.side
        found: set[tuple[int, int]] = set()
        code = size = None
        held, count = [], 0

        def compared() -> Iterator[tuple[int, int]]:
            x, y = (np.concatenate(part) for part in zip(*held))
            good = one_edits(x, y, code, size)
            yield from zip(x[good].tolist(), y[good].tolist())

        for owners, scanners, half, length in self.matches():
            begin, end = (len(half), 0) if side == "^" else (0, len(half))
            for a, b in groups_to_compare(owners, scanners, words, begin, end, length - len(half)):
                if length + 1 > WIDE:
                    found.update((i, j) for i in a for j in b if one_edit(words[i], words[j]))
                    continue
                if code is None:
                    size = np.array([min(len(w), WIDE) for w in words])
                    code = np.zeros((len(words), WIDE), np.uint8)
                    code[np.arange(WIDE)[None, :] < size[:, None]] = np.frombuffer("".join([w[:WIDE] for w in words]).encode("latin-1"), np.uint8)
                step = max(1, COMPARED // len(b))
                for at in range(0, len(a), step):
                    own = a[at : at + step]
                    held.append((np.repeat(own, len(b)), np.tile(b, len(own))))
                    count += len(own) * len(b)
                    if count >= COMPARED:
                        found.update(compared())
                        held, count = [], 0
        if held:
            found.update(compared())
        out = []
        for i, j in found:
            a, b = words[i], words[j]
            # Of equal words one way counts, and what both halves find counts at the first.
            if (len(a) < len(b) or a < b) and (side == "^" or not b.startswith(a[: len(a) // 2])):
                out.append((i, j))
        return out

    def near(self) -> pa.RecordBatch:
        """word, n_near, best_n, best: of every word with near words."""
        seen: dict[str, list] = {}
        for pair in self.pairs():
            for i, j in (pair, pair[::-1]):
                rank = (-self.counts[j], self.words[j])
                own = seen.setdefault(self.words[i], [0, rank])
                own[0] += 1
                own[1] = min(own[1], rank)
        of = lambda f, kind: pa.array([f(v) for v in seen.values()], kind)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), of(lambda v: v[0], pa.int64()), of(lambda v: -v[1][0], pa.int64()), of(lambda v: v[1][1], pa.string())], schema=NEAR)


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word) of the words that have near words."""

    def run(batches):
        shard, last = Shard(""), None
        for batch in batches:
            for side, key, block, scans, word, n in zip(*(batch.column(c).to_pylist() for c in ("side", "key", "block", "scans", "word", "n"))):
                if (side, key, block) != last:
                    last = (side, key, block)
                    if side != shard.side or len(shard.words) >= SCAN:
                        yield shard.near()
                        shard = Shard(side)
                    shard.open()
                elif scans and len(shard.scanners) >= SCAN:
                    yield shard.near()
                    shard = shard.onward()
                shard.add(word, n, scans)
        yield shard.near()

    found = visits(words).repartition("side", "key", "block").sortWithinPartitions("side", "key", "block", "scans")
    seen = found.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min_by(F.struct("best_n", "best"), F.struct((-F.col("best_n")).alias("o"), F.col("best")))
    return seen.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best_n"), F.col("b.best"))


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """word and root, from rows (word, form) whose chains have an end: pointers are doubled until none moves."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = checkpoint(at.join(onward, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at
    raise RuntimeError(f"forms are not settled after {max_rounds} rounds")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n from rows (word, n): the form is the most frequent near word, if it is at
    least `ratio` times as frequent; the root is where the forms lead."""
    words = checkpoint(words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near_words(words), "word", "left")
    formed = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of the documents' whole texts."""
    return variants(word_counts(docs, id_col, text_col))
