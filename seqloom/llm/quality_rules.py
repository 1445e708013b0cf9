"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects a document whose measure lies beyond a cutoff. For each stratum (language) and rule, the labelled
good documents are the holdout: a cutoff is safe if the exact binomial tail P(Bin(n, alpha) <= rejected) is at most
its share of delta. Within a stratum and rule the cutoffs of a fixed grid are tested from the loosest to the tightest
and testing ends at the first that is not safe (a fixed sequence needs no correction); strata and rules share delta
equally (Bonferroni). So, with probability 1 - delta, no chosen cutoff rejects more than alpha of the good documents
of its stratum, over all strata and rules at once.

The measures of all documents are written once to the shared folder, as one small row each; the holdout counts are
partial sums over all labelled rows, so no stratum is gathered anywhere.

Defined results: a null text has no words and fails the base rule; a null language is a stratum of its own; a stratum
without enough labelled documents has no cutoffs, and only the base rule holds there; several labels of a document
count as one, good only if all are good; null labels are left out; repeated rows give repeated rows; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint

MIN_WORDS, MAX_REPEAT = 50, 0.5
ALPHA, DELTA = 0.01, 0.05
#: Rule: its measure (larger is worse), and cutoffs from the loosest to the tightest.
RULES = {
    "long_words": ("word_chars / n_words", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    "short_words": ("-word_chars / n_words", (-1.5, -2.0, -2.5, -3.0, -3.5, -4.0)),
    "symbols": ("n_symbols / word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
}
#: Strata up to this number are broadcast; beyond it they are joined by key.
MAX_BROADCAST_STRATA = 10_000


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    words = base.select("doc_id", "stratum", "text", F.expr(r"array_remove(split(text, '[ \\x09-\\x0D]+'), '')").alias("w"), F.expr(r"filter(split(text, '\n'), x -> x rlike '[^ \\x09-\\x0D]')").alias("lines"))
    counted = words.select(
        "doc_id", "stratum", "w",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.length(F.translate("text", " \t\n\v\f\r", "")).cast("long").alias("word_chars"),
        F.expr("cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        # The bits that a word's place takes below its window's hash.
        F.expr("cast(ceil(log2(size(w) + 1)) as int)").alias("b"),
    )
    keyed = counted.withColumn("keys", F.expr("CASE WHEN n_words >= 4 THEN sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint))) END"))
    # Windows next to each other in this order with the same hash are compared word by word.
    place = lambda x: f"cast({x} & (shiftleft(1L, b) - 1) as int)"
    same = lambda x, y: f"({y} is not null AND shiftright({x}, b) = shiftright({y}, b) AND " + " AND ".join(f"w[{place(x)} + {d}] = w[{place(y)} + {d}]" for d in range(3)) + ")"
    twice = keyed.withColumn("twice", F.expr(f"transform(filter(keys, (x, k) -> {same('x', 'get(keys, k - 1)')} OR {same('x', 'get(keys, k + 1)')}), x -> {place('x')})"))
    repeats = F.expr("cast(coalesce(size(array_distinct(flatten(transform(twice, i -> array(i, i + 1, i + 2))))), 0) as bigint)")
    return twice.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.size("twice") > 0, repeats).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def measure_of(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.expr(f"cast({over} as double) / nullif({under}, 0)")


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series at x + 10, shifted back."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return series - F.log(product)


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to rounding; 1 where k / n > p, as such a cutoff cannot be safe. Terms that lie over
    60 deviations below k are under the precision of a double and left out."""
    n, k = n.cast("double"), k.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(60 * F.sqrt(n * p * (1 - p)) + 60)).cast("int")
    folded = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, j: F.struct((s["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"],
    )
    return F.when((n == 0) | (k > n * p), F.lit(1.0)).otherwise(F.exp(top) * folded)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum, rule, cutoff, n, k, p_value and safe, for each cutoff of the grids."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("label")).where("label = 1").select("doc_id")
    holdout = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    sums = [F.sum((F.coalesce(measure_of(rule), F.lit(0.0)) > c).cast("long")).alias(f"{rule}_{i}") for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    counted = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("at"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)])
    rows = counted.select("stratum", "n", F.expr("count(*) over ()").alias("strata"), F.inline(tests))  # one row a stratum
    tested = rows.withColumn("p_value", tail(F.col("n"), F.col("k"), alpha)).withColumn("level", delta / (F.col("strata") * len(RULES)))
    failed = F.expr("max(p_value > level) over (partition by stratum, rule order by at rows between unbounded preceding and current row)")
    return tested.withColumn("safe", ~failed)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts of each document, base_failed, and kept: not failed, and beyond no chosen cutoff of its stratum."""
    measured = checkpoint(measures(docs, id_col, text_col, stratum_col))
    tested = cutoffs(measured, labels, alpha, delta, id_col)
    chosen = checkpoint(tested.where("safe").groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES]))
    if chosen.count() <= MAX_BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    chosen = chosen.withColumnRenamed("stratum", "chosen_stratum")
    joined = measured.join(chosen, F.col("stratum").eqNullSafe(F.col("chosen_stratum")), "left")
    beyond = F.lit(False)
    for rule in RULES:
        beyond = beyond | F.coalesce(measure_of(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~beyond).alias("kept"))
