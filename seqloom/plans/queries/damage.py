"""Queries: terminal damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import damage as fn
from seqloom.functions.special import erfc_sql
from seqloom.operators import damage as dm
from seqloom.operators import pairs
from seqloom.plans import reads as rd
from seqloom.plans.queries.pairs import SUMMARY
from seqloom.plans.queries.sequence import six
from seqloom.plans.registry import query

SEG = """, seg AS (SELECT read_idx, seq, n, substr(seq, 1, n) AS five, substr(seq, length(seq) - n + 1, n) AS three
  FROM (SELECT read_idx, seq, least(15, length(seq) // 4, length(seq) // 2) AS n FROM reads))"""


def _n(c: str, letters: str) -> str:
    return f"length(regexp_replace({c}, '[^{letters}]', '', 'g'))"


LENGTH_FACTOR = "(CASE WHEN length(seq) < 50 THEN 0.9 WHEN length(seq) < 100 THEN 0.7 WHEN length(seq) < 150 THEN 0.5 WHEN length(seq) < 200 THEN 0.3 ELSE 0.1 END)::DOUBLE"
BALANCE = "(CASE WHEN d5 > 0.2::DOUBLE AND d3 > 0.2::DOUBLE THEN 1 - abs(d5 - d3) / greatest(d5 + d3, 0.1::DOUBLE) ELSE 0.5::DOUBLE END)"
FAST = f"""{SEG}, c AS (SELECT *, {_n('five', 'T')} AS t, {_n('five', 'C')} AS c, {_n('three', 'A')} AS a, {_n('three', 'G')} AS g FROM seg),
  e AS (SELECT read_idx, seq,
    0.7::DOUBLE * CASE WHEN c > 0 THEN least(t::DOUBLE / (t + c), 0.8::DOUBLE) ELSE 0.2::DOUBLE END + 0.3::DOUBLE * CASE WHEN n >= 3 AND t > 0 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS d5,
    0.7::DOUBLE * CASE WHEN g > 0 THEN least(a::DOUBLE / (a + g), 0.8::DOUBLE) ELSE 0.2::DOUBLE END + 0.3::DOUBLE * CASE WHEN n >= 3 AND a > 0 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS d3 FROM c),
  fast AS (SELECT read_idx, d5, d3, 0.4::DOUBLE * (d5 + d3) / 2 + 0.35::DOUBLE * {LENGTH_FACTOR} + 0.25::DOUBLE * {BALANCE} AS combined FROM e)"""


@query(f"{FAST} SELECT read_idx, round(d5, 6) AS damage5, round(d3, 6) AS damage3, round(combined, 6) AS combined FROM fast")
def damage_fast(spark, sf):
    return dm.fast_damage(rd.reads(spark, sf)).select("read_idx", *[six(c).alias(c) for c in ("damage5", "damage3", "combined")])


@query(f"{SEG} SELECT read_idx, CASE WHEN n >= 3 AND contains(five, 'T') THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS w5, CASE WHEN n >= 3 AND contains(three, 'A') THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS w3 FROM seg")
def position_weight(spark, sf):
    r = dm.with_segments(rd.reads(spark, sf))
    return r.select("read_idx", six(fn.position_weight_literal(F.col("five"), 5)).alias("w5"), six(fn.position_weight_literal(F.col("three"), 3)).alias("w3"))


@query(f"""SELECT read_idx, {LENGTH_FACTOR} AS length_factor, (CASE WHEN length(seq) <= 50 THEN 0.9 WHEN length(seq) <= 100 THEN 0.7 WHEN length(seq) <= 150 THEN 0.5 WHEN length(seq) <= 200 THEN 0.3 ELSE 0.1 END)::DOUBLE AS fragment_factor,
  round(least(1, greatest(0, (length(seq) - 30) / 120.0::DOUBLE)), 6) AS normalised FROM reads""")
def length_factors(spark, sf):
    n = F.length("seq")
    return rd.reads(spark, sf).select("read_idx", fn.length_factor(n).alias("length_factor"), fn.fragment_factor(n).alias("fragment_factor"), six(fn.range_normalised(n.cast("double"), 30, 150)).alias("normalised"))


def _change(segment: str, letter: str, tag: str = "") -> str:
    """Rows k of all cuts, the first best one, and the background rate; a tag tells the tables of two ends apart."""
    return f"""{'' if tag else SEG}, k{tag} AS (SELECT read_idx, n, {segment} AS s, unnest(range(3, n - 2)) AS k FROM seg WHERE n >= 6),
  st{tag} AS (SELECT read_idx, k, abs({_n('substr(s, 1, k)', letter)}::DOUBLE / k - {_n('substr(s, k + 1)', letter)}::DOUBLE / (n - k)) * sqrt((k * (n - k))::DOUBLE / n) AS stat FROM k{tag}),
  best{tag} AS (SELECT read_idx, k, stat FROM (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY stat DESC, k) AS r FROM st{tag} WHERE stat > 0) WHERE r = 1),
  cp{tag} AS (SELECT seg.read_idx, {segment} AS s, n, length(seq) < 15 AS tiny, k AS position, coalesce(stat, 0) AS stat,
    CASE WHEN n > least(6, n // 2) THEN {_n(f'substr({segment}, least(6, n // 2) + 1)', letter)}::DOUBLE / (n - least(6, n // 2)) ELSE 0.25::DOUBLE END AS rate
    FROM seg LEFT JOIN best{tag} USING (read_idx)),
  z{tag} AS (SELECT *, CASE WHEN rate > 0 THEN stat / sqrt(rate) / sqrt(2.0::DOUBLE) ELSE 100.0::DOUBLE END AS z FROM cp{tag})"""


def _change_sql(segment: str, letter: str) -> str:
    return f"{_change(segment, letter)} SELECT read_idx, position::INTEGER AS position, round(stat, 6) AS stat, round(CASE WHEN position IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * {erfc_sql('z')} END, 6) AS pvalue FROM z".replace("FROM reads", "FROM all_reads")


@query(_change_sql("five", "T"))
def change_point_5p(spark, sf):
    return dm.change_points(rd.all_reads(spark, sf).select("read_idx", "seq")).select("read_idx", F.col("position5").alias("position"), six("stat5").alias("stat"), six("pvalue5").alias("pvalue"))


@query(_change_sql("three", "A"))
def change_point_3p(spark, sf):
    return dm.change_points(rd.all_reads(spark, sf).select("read_idx", "seq")).select("read_idx", F.col("position3").alias("position"), six("stat3").alias("stat"), six("pvalue3").alias("pvalue"))


def _ratio(letter: str) -> str:
    before, after = f"{_n('substr(s, 1, position)', letter)}::DOUBLE / position", f"{_n('substr(s, position + 1)', letter)}::DOUBLE / (n - position)"
    return f"CASE WHEN {after} > 0 THEN ({before}) / ({after}) ELSE 1.0::DOUBLE END"


@query(f"""{_change('five', 'T')} SELECT read_idx, round(CASE WHEN tiny THEN 0.0::DOUBLE WHEN position IS NULL THEN 0.1::DOUBLE
  ELSE 0.2::DOUBLE + 0.6::DOUBLE * (least((({_ratio('T')} - 1) + ({_ratio('A')} - 1)) / 2, 2.0::DOUBLE) / 2) END, 6) + 0.0::DOUBLE AS score FROM z""".replace("FROM reads", "FROM all_reads"))
def change_point_score(spark, sf):
    return dm.change_points(rd.all_reads(spark, sf).select("read_idx", "seq")).select("read_idx", six("score5").alias("score"))


@query(f", z AS (SELECT read_idx, (length(seq) - 60) / 20.0::DOUBLE AS z FROM reads) SELECT read_idx, round(0.5::DOUBLE * {erfc_sql('z')}, 6) AS pvalue FROM z")
def pvalue_erfc(spark, sf):
    return rd.reads(spark, sf).withColumn("z", (F.length("seq") - 60) / F.lit(20.0)).select("read_idx", six(fn.one_tailed("z")).alias("pvalue"))


SITES = f"""{SEG}, p AS (SELECT read_idx, n, five, three, unnest(range(0, n)) AS i FROM seg),
  b AS (SELECT read_idx, n, i, five[i + 1] AS x, five[i + 2] AS x_next, three[i + 1] AS y, CASE WHEN i > 0 THEN three[i] ELSE '' END AS y_before, n - i - 1 AS d FROM p),
  sites AS (
    SELECT read_idx, 5 AS "end", i AS pos, (CASE WHEN x = 'C' THEN 0.1 WHEN x_next = 'G' THEN 0.85 WHEN i < 3 THEN 0.75 WHEN i < 6 THEN 0.65 ELSE 0.5 END)::DOUBLE AS prob FROM b WHERE x IN ('T', 'C')
    UNION ALL
    SELECT read_idx, 3, i, (CASE WHEN y = 'A' THEN CASE WHEN y_before = 'C' THEN 0.8 WHEN d = 0 THEN 0.75 WHEN d < 3 THEN 0.65 WHEN d < 6 THEN 0.55 ELSE 0.45 END
      ELSE CASE WHEN y_before = 'C' THEN 0.18 WHEN d < 3 THEN 0.14 ELSE 0.07 END END)::DOUBLE FROM b WHERE y IN ('A', 'G'))"""


def _sites(spark, sf):
    r = dm.with_segments(rd.reads(spark, sf))
    ends = F.array(*[F.struct(F.lit(e).alias("end"), fn.sites(F.col(c), e).alias("sites")) for e, c in ((5, "five"), (3, "three"))])
    return r.select("read_idx", F.inline(ends))


@query(f'{SITES} SELECT read_idx, "end"::INTEGER AS "end", count(*)::INTEGER AS sites, sum(pos)::BIGINT AS places, round(sum(prob), 6) AS prob FROM sites GROUP BY read_idx, "end"')
def deamination_sites(spark, sf):
    total = lambda f: F.aggregate("sites", F.lit(0.0), lambda a, x: a + x[f])
    return _sites(spark, sf).where(F.size("sites") > 0).select("read_idx", "end", F.size("sites").alias("sites"), total("pos").cast("long").alias("places"), six(total("prob")).alias("prob"))


@query(f"""{SITES} SELECT read_idx, "end"::INTEGER AS "end", round(sum(prob) / sum(exp(-0.3::DOUBLE * pos)), 6) AS amplitude,
  round(greatest(0.0::DOUBLE, 1 - sqrt(avg((exp(-0.3::DOUBLE * pos) - prob) * (exp(-0.3::DOUBLE * pos) - prob))) / avg(prob)), 6) AS quality FROM sites GROUP BY read_idx, "end\"""")
def exp_fit_fixed_lambda(spark, sf):
    fitted = _sites(spark, sf).where(F.size("sites") > 0).withColumn("f", fn.fit(F.col("sites"), 0.3))
    return fitted.select("read_idx", "end", six("f.amplitude").alias("amplitude"), six("f.quality").alias("quality"))


def _quality(rate: str) -> str:
    """The fit of exp(-rate place) to the list s of sites."""
    return f"greatest(0.0::DOUBLE, 1 - sqrt(list_avg(list_transform(s, lambda x: (exp(-({rate}) * x.pos) - x.prob) * (exp(-({rate}) * x.pos) - x.prob)))) / list_avg(list_transform(s, lambda x: x.prob)))"


LISTS = f"""{SITES}, lists AS (SELECT read_idx, "end", list({{'pos': pos, 'prob': prob}} ORDER BY pos) AS s FROM sites GROUP BY read_idx, "end")"""
TERNARY = f"""{LISTS}, t AS (
    SELECT read_idx, "end", s, 0 AS step, 0.01::DOUBLE AS low, 2.0::DOUBLE AS high, 0.0::DOUBLE AS rate, 0.0::DOUBLE AS quality FROM lists WHERE len(s) >= 3
    UNION ALL
    SELECT read_idx, "end", s, step + 1, CASE WHEN f1 > f2 THEN low ELSE m1 END, CASE WHEN f1 > f2 THEN m2 ELSE high END,
      CASE WHEN greatest(f1, f2) > quality THEN CASE WHEN f1 > f2 THEN m1 ELSE m2 END ELSE rate END, greatest(f1, f2, quality)
    FROM (SELECT *, {_quality('m1')} AS f1, {_quality('m2')} AS f2 FROM (SELECT *, low + (high - low) / 3 AS m1, high - (high - low) / 3 AS m2 FROM t WHERE step < 8))),
  found AS (SELECT read_idx, "end", rate, quality FROM t WHERE step = 8)"""
HILL = f"""{LISTS}, h AS (
    SELECT read_idx, "end", s, 0.05::DOUBLE AS low, 2.5::DOUBLE AS high, NULL::DOUBLE AS rate FROM lists
    UNION ALL
    SELECT read_idx, "end", s, CASE WHEN f_left <= f_mid AND f_right > f_mid THEN mid ELSE low END, CASE WHEN f_left > f_mid THEN mid ELSE high END,
      CASE WHEN f_left <= f_mid AND f_right <= f_mid THEN mid END
    FROM (SELECT *, {_quality('mid')} AS f_mid, {_quality('mid - 0.05::DOUBLE')} AS f_left, {_quality('mid + 0.05::DOUBLE')} AS f_right
          FROM (SELECT *, (low + high) / 2 AS mid FROM h WHERE rate IS NULL AND high - low > 0.01::DOUBLE))),
  rates AS (SELECT read_idx, "end", s, coalesce(rate, (low + high) / 2) AS rate FROM h WHERE rate IS NOT NULL OR high - low <= 0.01::DOUBLE),
  found AS (SELECT *, {_quality('rate')} AS quality, list_sum(list_transform(s, lambda x: x.prob)) / list_sum(list_transform(s, lambda x: exp(-rate * x.pos))) AS amplitude FROM rates)"""


def _both_ends(columns: str) -> str:
    return f'SELECT reads.read_idx, {columns} FROM reads LEFT JOIN found a ON a.read_idx = reads.read_idx AND a."end" = 5 LEFT JOIN found b ON b.read_idx = reads.read_idx AND b."end" = 3'


@query(f"{TERNARY} " + _both_ends("round(coalesce(a.rate, 0), 6) AS ternary5, round(coalesce(b.rate, 0), 6) AS ternary3, round(coalesce(a.quality, 0), 6) AS ternary_fit5, round(coalesce(b.quality, 0), 6) AS ternary_fit3"))
def decay_ternary(spark, sf):
    return dm.fit_decay(rd.reads(spark, sf)).select("read_idx", *[six(c).alias(c) for c in ("ternary5", "ternary3", "ternary_fit5", "ternary_fit3")])


# Without sites the search stops at its first place.
@query(f"{HILL} " + _both_ends("round(coalesce(a.rate, 1.275::DOUBLE), 6) AS lambda5, round(coalesce(b.rate, 1.275::DOUBLE), 6) AS lambda3, round(coalesce(a.quality, 0), 6) AS fit5, round(coalesce(b.quality, 0), 6) AS fit3"))
def decay_hill(spark, sf):
    return dm.fit_decay(rd.reads(spark, sf)).select("read_idx", *[six(c).alias(c) for c in ("lambda5", "lambda3", "fit5", "fit3")])


RATIO = """, site AS (SELECT read_idx, x.prob AS p, amplitude * exp(-rate * x.pos) AS m FROM (SELECT *, unnest(s) AS x FROM found)),
  ratio AS (SELECT read_idx, CASE WHEN bool_or(m <= 0 OR m >= 1) THEN -5.0::DOUBLE ELSE sum(p * ln(greatest(m, 1e-300::DOUBLE)) + (1 - p) * ln(greatest(1 - m, 1e-300::DOUBLE)) - p * ln(0.25::DOUBLE) - (1 - p) * ln(0.75::DOUBLE)) END AS llr FROM site GROUP BY read_idx)"""


@query(f"{HILL}{RATIO} SELECT reads.read_idx, round(coalesce(llr, 0), 6) + 0.0::DOUBLE AS llr FROM reads LEFT JOIN ratio USING (read_idx)")
def llr(spark, sf):
    return dm.fit_decay(rd.reads(spark, sf)).select("read_idx", six("llr").alias("llr"))


PVALUE = f"CASE WHEN position IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * {erfc_sql('z')} END AS pvalue"
SCORE = f"CASE WHEN tiny THEN 0.0::DOUBLE WHEN position IS NULL THEN 0.1::DOUBLE ELSE 0.2::DOUBLE + 0.6::DOUBLE * (least((({_ratio('T')} - 1) + ({_ratio('A')} - 1)) / 2, 2.0::DOUBLE) / 2) END AS score"
DETAILS = ("pvalue5", "pvalue3", "score5", "score3", "lambda5", "lambda3", "fit5", "fit3", "fit_excess")
ASSESS = f"""{TERNARY.replace(SEG, _change('five', 'T'), 1)}{_change('three', 'A', '3')}{FAST.replace(SEG, '', 1)},
  one AS (SELECT read_idx, {PVALUE}, {SCORE} FROM z), three AS (SELECT read_idx, {PVALUE}, {SCORE} FROM z3),
  parts AS (
    SELECT reads.read_idx, reads.seq, length(reads.seq) < 15 AS short, length(reads.seq) >= 100 OR c.t + c.c < 5 OR c.a + c.g < 5 AS fast, fast.d5 AS f5, fast.d3 AS f3,
      one.pvalue AS pvalue5, three.pvalue AS pvalue3, one.score AS score5, three.score AS score3,
      coalesce(a.rate, 0) AS lambda5, coalesce(b.rate, 0) AS lambda3, coalesce(a.quality, 0) AS fit5, coalesce(b.quality, 0) AS fit3
    FROM reads JOIN c USING (read_idx) JOIN fast USING (read_idx) JOIN one USING (read_idx) JOIN three USING (read_idx)
    LEFT JOIN found a ON a.read_idx = reads.read_idx AND a."end" = 5 LEFT JOIN found b ON b.read_idx = reads.read_idx AND b."end" = 3),
  joint AS (SELECT *, greatest(fit5 - 0.5::DOUBLE, 0) + greatest(fit3 - 0.5::DOUBLE, 0) AS fit_excess, CASE WHEN fast THEN f5 ELSE 0.6::DOUBLE * score5 + 0.4::DOUBLE * fit5 END AS d5, CASE WHEN fast THEN f3 ELSE 0.6::DOUBLE * score3 + 0.4::DOUBLE * fit3 END AS d3 FROM parts),
  assessed AS (SELECT *, 0.4::DOUBLE * (d5 + d3) / 2 + 0.35::DOUBLE * {LENGTH_FACTOR} + 0.25::DOUBLE * {BALANCE} AS whole FROM joint)
  SELECT read_idx, CASE WHEN short THEN 'short' WHEN fast THEN 'fast' ELSE 'accurate' END AS path, {', '.join(f"round(CASE WHEN short THEN 0.1::DOUBLE ELSE {c} END, 6) AS {name}" for name, c in (('damage5', 'd5'), ('damage3', 'd3'), ('combined', 'whole')))},
    {', '.join(f'CASE WHEN NOT short AND NOT fast THEN round({c}, 6) + 0.0::DOUBLE END AS {c}' for c in DETAILS)} FROM assessed""".replace("FROM reads", "FROM all_reads").replace("reads.read_idx", "all_reads.read_idx").replace("reads.seq", "all_reads.seq").replace("all_all_", "all_")


@query(ASSESS)
def damage_assess(spark, sf):
    got = dm.assess_damage(rd.all_reads(spark, sf))
    return got.select("read_idx", "path", *[six(c).alias(c) for c in ("damage5", "damage3", "combined")], *[F.when(~F.isnan(c), six(c)).alias(c) for c in DETAILS])


FRAGMENT = "(CASE WHEN length(seq) <= 50 THEN 0.9 WHEN length(seq) <= 100 THEN 0.7 WHEN length(seq) <= 150 THEN 0.5 WHEN length(seq) <= 200 THEN 0.3 ELSE 0.1 END)::DOUBLE"
ENSEMBLE = f""", mread AS (SELECT id AS read_idx, seq FROM mates UNION ALL SELECT concat(id, '/1'), seq FROM all_reads WHERE length(seq) < 30){HILL.replace(SEG, _change('five', 'T'), 1)}{_change('three', 'A', '3')}{SUMMARY},
  one AS (SELECT read_idx, {PVALUE}, {SCORE} FROM z), three AS (SELECT read_idx, {PVALUE}, {SCORE} FROM z3){RATIO},
  parts AS (
    SELECT mread.read_idx, mread.seq, one.pvalue AS v5, three.pvalue AS v3, one.score AS s5, three.score AS s3,
      {', '.join(f'CASE WHEN length(mread.seq) < 10 THEN 0 ELSE coalesce({c}, 0) END AS {name}' for c, name in (('llr', 'llr'), ('a.quality', 'fit5'), ('b.quality', 'fit3')))},
      coalesce(summary.support, 0.5::DOUBLE) AS support, coalesce((c_to_t + g_to_a)::DOUBLE / nullif(c_to_t + g_to_a + other, 0), 0) AS hits,
      coalesce(c_to_t + g_to_a + other, 0) AS mismatches, coalesce(overlap_size, 0) AS overlap_size
    FROM mread JOIN one USING (read_idx) JOIN three USING (read_idx) LEFT JOIN ratio USING (read_idx) LEFT JOIN summary ON base_id = mread.read_idx[:-3]
    LEFT JOIN found a ON a.read_idx = mread.read_idx AND a."end" = 5 LEFT JOIN found b ON b.read_idx = mread.read_idx AND b."end" = 3),
  weighed AS (SELECT *, (CASE WHEN length(seq) < 50 THEN 0.5 WHEN length(seq) < 100 THEN 0.4 ELSE 0.3 END)::DOUBLE * (CASE WHEN v5 < 0.05::DOUBLE OR v3 < 0.05::DOUBLE THEN 1.0 ELSE 0.5 END)::DOUBLE AS w1,
    (CASE WHEN llr > 2 AND fit5 > 0.6::DOUBLE AND fit3 > 0.4::DOUBLE THEN 0.5 WHEN llr > 0.5::DOUBLE THEN 0.4 ELSE 0.3 END)::DOUBLE AS w2,
    (CASE WHEN overlap_size <= 20 THEN 0.0 WHEN hits > 0.7::DOUBLE AND mismatches > 3 THEN 0.5 WHEN hits > 0.5::DOUBLE THEN 0.4 ELSE 0.2 END)::DOUBLE AS w3 FROM parts),
  shares AS (SELECT *, w1 / (w1 + w2 + w3) AS w_change, w2 / (w1 + w2 + w3) AS w_model, w3 / (w1 + w2 + w3) AS w_pair FROM weighed),
  ends AS (SELECT *, w_change * s5 + w_model * (0.1::DOUBLE + 0.8::DOUBLE * fit5) + w_pair * support AS d5, w_change * s3 + w_model * (0.1::DOUBLE + 0.8::DOUBLE * fit3) + w_pair * support AS d3 FROM shares)
  SELECT read_idx AS id, round(d5, 9) AS prob5, round(d3, 9) AS prob3, round(w_change, 9) AS w_change, round(w_model, 9) AS w_model, round(w_pair, 9) AS w_pair,
    round(0.35::DOUBLE * (d5 + d3) / 2 + 0.25::DOUBLE * (CASE WHEN llr > 0 THEN llr / 10 ELSE 0 END + CASE WHEN least(v5, v3) < 0.1::DOUBLE THEN 1 - least(10 * least(v5, v3), 1) ELSE 0 END) / 2
      + 0.25::DOUBLE * {FRAGMENT} + 0.15::DOUBLE * {BALANCE}, 9) AS authenticity FROM ends""".replace("FROM reads", "FROM mread")


@query(ENSEMBLE, "mates")
def ensemble_damage(spark, sf):
    short = rd.all_reads(spark, sf).where(F.length("seq") < 30).select(F.concat("id", F.lit("/1")).alias("id"), "seq")  # without mates
    got = dm.ensemble_damage(pairs.with_evidence(rd.mates(spark, sf).unionByName(short)))
    return got.select("id", *[F.round(c, 9).alias(c) for c in ("prob5", "prob3", "w_change", "w_model", "w_pair", "authenticity")])
