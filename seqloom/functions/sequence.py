"""Sequence functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_content(seq: Column) -> Column:
    """Share of G and C in all bases, in either case; 0 for an empty sequence."""
    return F.when(F.length(seq) > 0, count_of(seq, "GCgc") / F.length(seq)).otherwise(F.lit(0.0))


def norm_length(seq: Column) -> Column:
    """log2 of the length over 12; 0 for an empty sequence."""
    return F.when(F.length(seq) > 0, F.log2(F.length(seq).cast("double")) / 12).otherwise(F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    """Complement in the same case, N kept, other letters N, reversed."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def windows(seq: Column, k: int, step: int = 1) -> Column:
    """Substrings of length k; none for a shorter sequence."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)), F.lit(step))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_index(kmer: Column) -> Column:
    """Base-4 number with A 0, C 1, G 2, T 3, the first base highest; the k-mer must be of ACGT."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("int")


def is_standard(base: Column) -> Column:
    return F.upper(base).isin("A", "C", "G", "T")


def base_index(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; any other letter counts as A."""
    return F.greatest(F.instr(F.lit("ACGT"), F.upper(base)) - 1, F.lit(0))


def phred(quality: Column) -> Column:
    """Scores of a quality string: character code less 33."""
    return F.transform(F.sequence(F.lit(1), F.length(quality)), lambda i: (F.ascii(F.substr(quality, i, F.lit(1))) - 33).cast("smallint"))


# Endings that name a mate, in the order in which they are tried; the token goes wherever it stands.
ENDINGS = ("/1", "/2", ".1", ".2", "_1", "_2", "-1", "-2", ":1", ":2", " R1", " R2", " 1", " 2", ".pair.1", ".pair.2", "#1", "#2")
# Tokens within an id, which become one underscore, and what must not be in the id beside them.
INSIDE = (("_R1_", ()), ("_R2_", ()), ("_1_", ("_10_", "_11_")), ("_2_", ("_20_", "_21_")))


def mate_rules(read_id: Column) -> list[tuple[Column, Column, int]]:
    """Condition, base id and mate of each rule; the first that holds decides."""
    rules = [(F.endswith(read_id, F.lit(t)), F.replace(read_id, F.lit(t), F.lit("")), int(t[-1])) for t in ENDINGS]
    for token, barred in INSIDE:
        holds = F.contains(read_id, F.lit(token))
        for other in barred:
            holds = holds & ~F.contains(read_id, F.lit(other))
        rules.append((holds, F.replace(read_id, F.lit(token), F.lit("_")), int(token.strip("_R"))))
    return rules


def _first(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return out


def base_id(read_id: Column) -> Column:
    """The id without its mate token."""
    return _first([(h, b) for h, b, _ in mate_rules(read_id)], read_id)


def mate(read_id: Column) -> Column:
    """1 or 2, or 0 if the id names no mate."""
    return _first([(h, F.lit(m)) for h, _, m in mate_rules(read_id)], F.lit(0))
