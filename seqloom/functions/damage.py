"""Terminal-damage statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.sequence import count_of
from seqloom.functions.special import erfc_sql


def segment_length(seq: Column, window: int = 5) -> Column:
    """Bases of a terminal segment: three windows or a quarter of the read, at most half of it."""
    length = F.length(seq)
    return F.least(F.least(F.lit(3 * window), F.floor(length / 4)), F.floor(length / 2)).cast("int")


def five(seq: Column, n: Column) -> Column:
    return F.substr(seq, F.lit(1), n)


def three(seq: Column, n: Column) -> Column:
    return F.substr(seq, F.length(seq) - n + 1, n)


def _share(hits: Column, all_: Column) -> Column:
    return F.when(all_ - hits > 0, F.least(hits / F.nullif(all_, F.lit(0)), F.lit(0.8))).otherwise(F.lit(0.2))


def position_weight(segment: Column, letters: str) -> Column:
    """The position-weighted score: its weights make it 1 when the segment has the base, and 0.2 when it has not or is
    shorter than three bases."""
    return F.when((F.length(segment) >= 3) & (count_of(segment, letters) > 0), F.lit(1.0)).otherwise(F.lit(0.2))


def position_weight_literal(segment: Column, end: int) -> Column:
    """The same score as it is defined: each T (5') or A (3') counts exp(-0.3 distance to the end) times a weight of 1 to
    1.5 for the letters beside it, over the same sum without those weights, 1 at most."""
    n = F.length(segment)
    letter = lambda i: F.upper(F.substr(segment, i + 1, F.lit(1)))
    decay = lambda i: F.exp((i if end == 5 else n - i - 1) * F.lit(-0.3))

    def context(i: Column) -> Column:
        left, right = letter(i - 1), letter(i + 1)
        strong = right == "G" if end == 5 else left == "C"
        return F.when((i == 0) | (i == n - 1), 1.0).when(strong, 1.5).when(left.isin("C", "G") | right.isin("C", "G"), 1.2).otherwise(1.0)

    hits = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: letter(i) == ("T" if end == 5 else "A"))
    top = F.aggregate(hits, F.lit(0.0), lambda s, i: s + decay(i) * context(i))
    low = F.aggregate(hits, F.lit(0.0), lambda s, i: s + decay(i))
    return F.when((n >= 3) & (F.size(hits) > 0), F.least(top / low, F.lit(1.0))).otherwise(F.lit(0.2))


def length_factor(length: Column) -> Column:
    return F.when(length < 50, 0.9).when(length < 100, 0.7).when(length < 150, 0.5).when(length < 200, 0.3).otherwise(0.1)


def fragment_factor(length: Column) -> Column:
    return F.when(length <= 50, 0.9).when(length <= 100, 0.7).when(length <= 150, 0.5).when(length <= 200, 0.3).otherwise(0.1)


def balance_factor(d5: Column, d3: Column) -> Column:
    return F.when((d5 > 0.2) & (d3 > 0.2), 1 - F.abs(d5 - d3) / F.greatest(d5 + d3, F.lit(0.1))).otherwise(F.lit(0.5))


def range_normalised(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def combined(d5: Column, d3: Column, length: Column) -> Column:
    return 0.4 * (d5 + d3) / 2 + 0.35 * length_factor(length) + 0.25 * balance_factor(d5, d3)


def fast_ends(segment5: Column, segment3: Column) -> tuple[Column, Column]:
    """5' and 3' scores of the fast path, from the two segments."""
    t, tc = count_of(segment5, "Tt"), count_of(segment5, "TtCc")
    a, ag = count_of(segment3, "Aa"), count_of(segment3, "AaGg")
    return 0.7 * _share(t, tc) + 0.3 * position_weight(segment5, "Tt"), 0.7 * _share(a, ag) + 0.3 * position_weight(segment3, "Aa")


def one_tailed(z_column: str) -> Column:
    """0.5 erfc(z) of a double column."""
    return F.expr(f"0.5e0 * {erfc_sql(z_column)}")


def sites(segment: Column, end: int) -> Column:
    """array of struct(pos, prob): bases that deamination may have made, counted from the segment's start."""
    m = F.length(segment)
    letter = lambda i: F.upper(F.substr(segment, i + 1, F.lit(1)))
    if end == 5:
        prob = lambda i: F.when(letter(i) == "T", F.when(letter(i + 1) == "G", 0.85).when(i < 3, 0.75).when(i < 6, 0.65).otherwise(0.5)).when(letter(i) == "C", F.lit(0.1))
    else:
        away = lambda i: m - i - 1
        after_c = lambda i: (i > 0) & (letter(i - 1) == "C")
        prob = lambda i: F.when(letter(i) == "A", F.when(after_c(i), 0.8).when(away(i) == 0, 0.75).when(away(i) < 3, 0.65).when(away(i) < 6, 0.55).otherwise(0.45)).when(
            letter(i) == "G", F.when(after_c(i), 0.18).when(away(i) < 3, 0.14).otherwise(0.07)
        )
    found = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: F.struct(i.alias("pos"), prob(i).alias("prob")))
    return F.when(m > 0, F.filter(found, lambda s: s["prob"].isNotNull())).otherwise(F.array().cast("array<struct<pos:int,prob:double>>"))


def fit(found: Column, rate: float) -> Column:
    """struct(amplitude, quality) of exp(-rate pos) against the sites' probabilities; zeros without sites."""
    total = lambda f: F.aggregate(found, F.lit(0.0), lambda s, x: s + f(x))
    pred = lambda x: F.exp(x["pos"] * F.lit(-rate))
    n = F.size(found)
    p, q = total(lambda x: x["prob"]), total(pred)
    rmse = F.sqrt(total(lambda x: (pred(x) - x["prob"]) * (pred(x) - x["prob"])) / n)
    zero = F.struct(F.lit(0.0).alias("amplitude"), F.lit(0.0).alias("quality"))
    return F.when((n > 0) & F.lit(rate > 0), F.struct((p / q).alias("amplitude"), F.greatest(F.lit(0.0), 1 - rmse / (p / n)).alias("quality"))).otherwise(zero)
