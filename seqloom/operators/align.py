"""Alignment of mates: all of mate 1 against a stretch of the reverse complement of mate 2, with affine gaps.

A path with gaps scores at least 6 less than the letters of mate 1, so mates of one length that differ in at most three places
are aligned without gaps: these are settled by counting, all of a batch at once. Of any other pair, the best score without
gaps or with one bounds the gaps of a path that is as good, and so the diagonals that it can reach; only these are filled in.

All pairs of a group are aligned at once, along their tables' anti-diagonals, whose cells do not depend on each other: an
anti-diagonal of all pairs is one array operation. Each cell keeps where its score came from, so that the paths are found
backwards from the best ends, a step of all pairs at a time. Groups are of like size and like number of diagonals, and their
tables have at most `CELLS` cells together (a longer pair is a group of its own).

A match counts 1, a mismatch -1, a gap of n bases -5 - n; letters are compared as they stand. Of equal scores the end that
comes first wins, and on the way back a pair of bases before a gap in mate 2, and that before a gap in mate 1."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

OPEN, EXTEND, CELLS = -6, -1, 1 << 24  # a gap's first base, and each further one
ALIKE = 3  # so many differences lose no more than the cheapest gap
PAIR, ONLY_1, ONLY_2 = range(3)  # what a column of an alignment holds
_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _a, _b in zip("ACGTacgtNn", "TGCAtgcaNn"):
    _COMPLEMENT[ord(_a)] = ord(_b)
# A cell's bits: a gap in y beats a pair of bases, one in x beats both, the gap in y goes on, that in x goes on.
_KIND = np.array([(PAIR, ONLY_1, ONLY_2, ONLY_2)[c & 3] for c in range(16)] + [ONLY_1] * 16 + [ONLY_2] * 16, np.uint8)
_NEXT = np.array([PAIR] * 16 + [ONLY_1 if c & 4 else PAIR for c in range(16)] + [ONLY_2 if c & 8 else PAIR for c in range(16)], np.uint8)


def codes(seqs: Sequence[str], width: int, flip: bool = False) -> np.ndarray:
    """Sequences by letters, padded with zeros; with `flip` their reverse complements."""
    out = np.zeros((len(seqs), width), np.uint8)
    for i, s in enumerate(seqs):
        own = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
        out[i, : len(own)] = _COMPLEMENT[own[::-1]] if flip else own
    return out


def differences(seq1: Sequence[str], seq2: Sequence[str], n: np.ndarray) -> np.ndarray:
    """In how many places each sequence differs from the reverse complement of the other, which is as long."""
    x, y = (np.frombuffer("".join(s).encode("ascii", "replace"), np.uint8) for s in (seq1, seq2))
    ends = np.cumsum(n)
    backwards = np.repeat(2 * ends - n - 1, n) - np.arange(len(x))
    return np.bincount(np.searchsorted(ends, np.flatnonzero(x != _COMPLEMENT[y[backwards]]), "right"), minlength=len(n))


def straight(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and begin in y of each pair's best path without gaps, the first of equals; a score far below all if y is shorter."""
    width = x.shape[1]
    best, at = np.full(len(n), -(1 << 40)), np.zeros(len(n), np.int64)
    inside, y = np.arange(width) < n[:, None], np.pad(y, ((0, 0), (0, width)))
    for o in range(int((m - n).max(initial=-1)) + 1):
        own = np.flatnonzero(m - n >= o)
        score = 2 * np.count_nonzero((x[own] == y[own, o : o + width]) & inside[own], axis=1) - n[own]
        better = score > best[own]
        best[own[better]], at[own[better]] = score[better], o
    return best, at


def one_gap(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of each pair's best path from begin to end of both with one gap."""
    k, apart = np.arange(x.shape[1]), (m - n)[:, None]
    inside, y = k < np.minimum(n, m)[:, None], np.pad(y, ((0, 0), (0, len(k))))
    before = (x == y[:, : len(k)]) & inside
    behind = (np.take_along_axis(x, np.minimum(k + np.maximum(-apart, 0), len(k) - 1), 1) == np.take_along_axis(y, k + np.maximum(apart, 0), 1)) & inside
    turn = np.cumsum(before.astype(np.int32) - behind, axis=1).max(axis=1, initial=0)
    return 2 * (np.count_nonzero(behind, axis=1) + turn) - np.minimum(n, m) - 5 - abs(m - n)


def aligned(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """Score, begin and end in y, and the path (runs of columns: kind, number) of each pair of rows; n and m are lengths."""
    best, at = straight(x, n, y, m)
    lost = n - best
    # A gap of one base in x, all else equal, loses 6: its path can end before a straight one that begins beyond 1.
    rest = np.flatnonzero((lost > 6) | (lost == 6) & (at > 1))
    found: list = [(s, b, b + k, [(PAIR, k)] if k else []) for s, b, k in zip(best.tolist(), at.tolist(), n.tolist())]
    # A path as good as the better of these has a columns of x only, b of y only and k gaps with 2 a + b + 5 k <= lost.
    x, n, y, m, lost = x[rest], n[rest], y[rest], m[rest], np.minimum(lost[rest], n[rest] - one_gap(x[rest], n[rest], y[rest], m[rest]))
    spare = np.maximum(lost - 5, 0) // 2  # such columns of x only
    for own in groups(n, m, spare):
        for p, path in zip(rest[own].tolist(), _by_table(x[own], n[own], y[own], m[own], spare[own])):
            found[p] = path
    return found


def _by_table(x, n, y, m, spare) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """The same, from tables of the diagonals (place in y less place in x) that paths with `spare` columns of x only reach.

    Scores are kept as 2 score - i - j: a match adds 0, so that letters' codes give what a pair of them adds."""
    pairs, width, height = len(n), int(n.max()), int(m.max())
    lowest, highest = -int(spare.max()), int((m - n + spare).max())
    small = 4 * (width + height) < 14_000
    dtype, low = (np.int16, -16_000) if small else (np.int32, -(1 << 29))
    first, longer = dtype(2 * OPEN - 1), dtype(2 * EXTEND - 1)
    # Rows are places in x, one on, with a row that stays low on either side.
    before, last, now, down, new_down, across = (np.full((width + 3, pairs), low, dtype) for _ in range(6))
    opened, apart = np.empty((width + 2, pairs), dtype), np.empty((width + 1, pairs), dtype)
    bits = np.empty((3, width + 1, pairs), bool)
    letters1, letters2 = np.zeros((width + 1, pairs), dtype), np.zeros((height + 1, pairs), dtype)
    np.multiply(x[:, :width].T, 4, out=letters1[1:], dtype=dtype, casting="unsafe")
    np.multiply(y[:, :height].T[::-1], 4, out=letters2[:height], dtype=dtype, casting="unsafe")
    d = np.arange(width + height + 1)
    a = np.maximum(np.maximum(d - height, 0), -((highest - d) // 2))  # places in x of each anti-diagonal
    b = np.minimum(np.minimum(d, width), (d - lowest) // 2)
    starts = np.concatenate([[0], np.cumsum(np.maximum(b - a + 1, 0))])
    came = np.empty((int(starts[-1]), pairs), np.uint8)
    best, end = np.full(pairs, -(1 << 60)), np.zeros(pairs, np.int64)
    for d, (a_, b_, start) in enumerate(zip(a.tolist(), b.tolist(), starts.tolist())):
        size = b_ - a_ + 1
        here, left = slice(a_ + 1, b_ + 2), slice(a_, b_ + 1)
        gap, flags, (one, two, on) = opened[: size + 1], came[start : start + size], bits[:, :size]
        np.add(last[a_ : b_ + 2], first, out=gap)
        new, side, cell = new_down[here], across[here], now[here]
        np.add(down[left], longer, out=new)
        np.greater(new, gap[:-1], out=one)
        np.left_shift(one.view(np.uint8), 2, out=flags)
        np.maximum(new, gap[:-1], out=new)
        np.add(side, longer, out=side)
        np.greater(side, gap[1:], out=on)
        np.left_shift(on.view(np.uint8), 3, out=on.view(np.uint8))
        np.bitwise_or(flags, on.view(np.uint8), out=flags)
        np.maximum(side, gap[1:], out=side)
        differ = apart[:size]
        np.bitwise_xor(letters1[a_ : b_ + 1], letters2[height - d + a_ : height - d + b_ + 1], out=differ)
        np.minimum(differ, dtype(4), out=differ)
        np.subtract(before[left], differ, out=cell)
        np.greater(new, cell, out=one)
        np.maximum(cell, new, out=cell)
        np.greater(side, cell, out=two)
        np.maximum(cell, side, out=cell)
        np.bitwise_or(flags, one.view(np.uint8), out=flags)
        np.left_shift(two.view(np.uint8), 1, out=two.view(np.uint8))
        np.bitwise_or(flags, two.view(np.uint8), out=flags)
        if a_ == 0:
            now[1], new_down[1], across[1] = -d, low, low  # y may begin anywhere
        for rows in (now, new_down, across):
            rows[a_] = rows[b_ + 2] = low
        whole = np.flatnonzero((n >= max(a_, d - height)) & (n <= b_) & (d - n <= m))
        if len(whole):
            own = (now[n[whole] + 1, whole].astype(np.int64) + d) >> 1
            better = own > best[whole]
            best[whole[better]], end[whole[better]] = own[better], d - n[whole[better]]
        before, last, now, down, new_down = last, now, before, new_down, down
    begin, runs = _paths(came, starts[:-1] - a, n, end, width + height)
    return list(zip(best.tolist(), begin.tolist(), end.tolist(), runs))


def _paths(came: np.ndarray, row: np.ndarray, n: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Begins and runs of columns, from cells whose row is that of their anti-diagonal and their place in x."""
    kinds = np.full((len(n), most + 1), 255, np.uint8)  # from the end; the last column ends every row
    begin, own = end.copy(), np.flatnonzero(n > 0)
    i, j, state = n[own], end[own], np.zeros(len(own), np.uint8)
    steps = 0
    while len(own):
        cell = came[row[i + j] + i, own]
        kind = _KIND[state << 4 | cell]
        state = _NEXT[kind << 4 | cell]
        kinds[own, most - 1 - steps] = kind
        i, j = i - (kind != ONLY_2), j - (kind != ONLY_1)
        steps += 1
        if not i.all():
            begin[own] = j
            stay = np.flatnonzero(i)
            own, i, j, state = own[stay], i[stay], j[stay], state[stay]
    kinds = kinds[:, most - steps :]
    flat = kinds.ravel()
    starts = np.append(0, np.flatnonzero(flat[1:] != flat[:-1]) + 1)
    size, real = np.diff(np.append(starts, len(flat))), flat[starts] != 255
    columns = list(zip(flat[starts[real]].tolist(), size[real].tolist()))
    cuts = np.searchsorted(starts[real] // kinds.shape[1], np.arange(len(n) + 1)).tolist()
    return begin, [columns[a:b] for a, b in zip(cuts, cuts[1:])]


def groups(n: np.ndarray, m: np.ndarray, spare: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of like size, whose tables fit together; with `spare`, tables of the diagonals from -spare to m - n + spare."""
    spare = n if spare is None else spare
    below, above = np.minimum(spare, n), np.minimum(m - n + spare, m)
    kind = np.frexp(np.maximum(below + above + 1, 1))[1]  # diagonals, in powers of two
    order = np.lexsort((m, n, kind))
    start = wide = low = high = 0
    for at, (k, n_, b, a) in enumerate(zip(*(v[order].tolist() for v in (kind, n, below, above)))):
        wide2, low2, high2 = max(wide, n_), max(low, b), max(high, a)
        if at > start and (k != last or (at - start + 1) * (wide2 + 1) * max(low2 + high2 + 1, 16) > CELLS):
            yield order[start:at]
            start, wide2, low2, high2 = at, n_, b, a
        wide, low, high, last = wide2, low2, high2, k
    if start < len(order):
        yield order[start:]


LETTERS = "MID"  # columns of both, of mate 1 only, of mate 2 only, as alignments name them


def alignments(pairs: DataFrame) -> DataFrame:
    """base_id, score, begin and end (in the reverse complement of mate 2), gaps (columns of one mate only) and path of each
    pair (base_id, seq1, seq2). A null sequence is empty; without mate 1 the score is 0 and the path empty."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seq1, seq2 = (pc.fill_null(batch.column(c), "").to_numpy(zero_copy_only=False) for c in ("seq1", "seq2"))
            n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (seq1, seq2))
            like, apart = np.flatnonzero(n == m), np.zeros_like(n)
            apart[like] = differences(seq1[like], seq2[like], n[like])
            rest = np.flatnonzero((n > 0) & ((n != m) | (apart > ALIKE)))
            score, begin, end, gaps = n - 2 * apart, np.zeros_like(n), n.copy(), np.zeros_like(n)
            paths = pc.if_else(pa.array(n > 0), pc.binary_join_element_wise(pa.array(n).cast(pa.string()), LETTERS[PAIR], ""), "")
            if len(rest):
                named, place = [""] * len(rest), np.arange(len(n))
                for group in groups(n[rest], m[rest], np.zeros_like(rest)):
                    own = rest[group]
                    x = codes(seq1[own], int(n[own].max()))
                    y = codes(seq2[own], int(m[own].max()), flip=True)
                    for at, i, (*numbers, path) in zip(group.tolist(), own.tolist(), aligned(x, n[own], y, m[own])):
                        score[i], begin[i], end[i] = numbers
                        gaps[i] = sum(k for kind, k in path if kind != PAIR)
                        named[at] = "".join(f"{k}{LETTERS[kind]}" for kind, k in path)
                place[rest] = len(n) + np.arange(len(rest))
                paths = pa.concat_arrays([paths, pa.array(named, pa.string())]).take(pa.array(place))
            numbers = [pa.array(v.astype(np.int32)) for v in (score, begin, end, gaps)]
            yield pa.RecordBatch.from_arrays([batch.column("base_id"), *numbers, paths], names=["base_id", "score", "begin", "end", "gaps", "path"])

    return pairs.select("base_id", "seq1", "seq2").mapInArrow(run, "base_id string, score int, begin int, end int, gaps int, path string")
