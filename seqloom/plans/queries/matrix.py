"""Queries: features, z-scores, covariance, components and k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import kmers, matrix
from seqloom.plans import reads as rd
from seqloom.plans.queries.sequence import six
from seqloom.plans.registry import GC, query

NAMES = kmers.names(2)
DINUCLEOTIDES = ", ".join(f"count(*) FILTER (k = '{n}')::DOUBLE / (len - 1) AS \"freq_{n}\"" for n in NAMES)
RAW = f""", w AS (SELECT read_idx, length(seq) AS len, {GC} AS gc, substr(seq, unnest(range(1, length(seq))), 2) AS k FROM reads),
  raw AS (SELECT read_idx, gc, {DINUCLEOTIDES}, log2(len) / 12 AS norm_length FROM w GROUP BY read_idx, len, gc)"""
COLUMNS = matrix.FEATURES18
ZSCORED = f"{RAW}, z AS (SELECT read_idx, " + ", ".join(f'CASE WHEN stddev_pop("{c}") OVER () > 1e-10::DOUBLE THEN ("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER () ELSE "{c}" END AS "{c}"' for c in COLUMNS) + " FROM raw)"


def _spread(rows):
    return rows.select("read_idx", *[six(F.col("x")[i]).alias(c) for i, c in enumerate(COLUMNS)])


def _rounded(table: str) -> str:
    return "SELECT read_idx, " + ", ".join(f'round("{c}", 6) + 0.0::DOUBLE AS "{c}"' for c in COLUMNS) + f" FROM {table}"


@query(f"{RAW} {_rounded('raw')}")
def features18_raw(spark, sf):
    return _spread(matrix.features18(rd.reads(spark, sf)))


@query(f"{ZSCORED} {_rounded('z')}")
def features18_zscore(spark, sf):
    return _spread(matrix.z_scores(matrix.features18(rd.reads(spark, sf))))


@query(f"{RAW}, c AS (" + " UNION ALL ".join(f'SELECT {i} AS i, {j} AS j, covar_samp("{a}", "{b}") AS cov FROM raw' for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i <= j) + ") SELECT i, j, round(cov, 8) + 0.0::DOUBLE AS cov FROM c")
def covariance(spark, sf):
    cov = matrix.covariance(matrix.features18(rd.reads(spark, sf)))
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double").withColumn("cov", F.round("cov", 8) + F.lit(0.0))


START = np.array([[0.3], [0.4], [0.5]])


@query(f""", g AS (SELECT {GC} AS gc FROM reads), c AS (SELECT gc, CASE WHEN abs(gc - 0.3::DOUBLE) <= abs(gc - 0.4::DOUBLE) AND abs(gc - 0.3::DOUBLE) <= abs(gc - 0.5::DOUBLE) THEN 0 WHEN abs(gc - 0.4::DOUBLE) <= abs(gc - 0.5::DOUBLE) THEN 1 ELSE 2 END AS cluster FROM g)
  SELECT cluster::INTEGER AS cluster, count(*) AS size, round(avg(gc), 6) AS centroid FROM c GROUP BY cluster""")
def lloyd_step(spark, sf):
    rows = matrix.features18(rd.reads(spark, sf)).select("read_idx", F.array(F.col("x")[0]).alias("x"))
    centroids, sizes = matrix.lloyd_step(rows, START)
    return spark.createDataFrame([(i, int(n), round(float(c[0]), 6)) for i, (n, c) in enumerate(zip(sizes, centroids))], "cluster int, size long, centroid double")


def _components(spark, sf):
    return matrix.principal_components(matrix.features18(rd.reads(spark, sf)), 8, scaled=True)


def _jacobi(d: int, sweeps: int) -> str:
    """Rotations of the symmetric matrix `a` (a list of d x d numbers) and of the unit matrix, pair by pair: `done` (a, v)."""
    i, j = f"((k - 1) // {d} + 1)", f"((k - 1) % {d} + 1)"
    at = lambda m, r, c: f"{m}[({r} - 1) * {d} + {c}]"
    mixed = lambda m: f"CASE {j} WHEN p THEN co * {at(m, i, 'p')} - si * {at(m, i, 'q')} WHEN q THEN si * {at(m, i, 'p')} + co * {at(m, i, 'q')} ELSE {m}[k] END"
    cells = f"range(1, {d * d + 1})"
    return f"""pairs AS (SELECT list({{'p': p, 'q': q}} ORDER BY p, q) AS l FROM (SELECT unnest(range(1, {d})) AS p), LATERAL (SELECT unnest(range(p + 1, {d + 1})) AS q)),
  turns AS (
    SELECT 0 AS t, a, list_transform({cells}, lambda k: CASE WHEN {i} = {j} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM matrix
    UNION ALL
    SELECT t + 1, list_transform({cells}, lambda k: CASE {i} WHEN p THEN co * {at('b', 'p', j)} - si * {at('b', 'q', j)} WHEN q THEN si * {at('b', 'p', j)} + co * {at('b', 'q', j)} ELSE b[k] END), v
    FROM (SELECT t, p, q, co, si, list_transform({cells}, lambda k: {mixed('a')}) AS b, list_transform({cells}, lambda k: {mixed('v')}) AS v
    FROM (SELECT *, 1 / sqrt(tan * tan + 1) AS co, tan / sqrt(tan * tan + 1) AS si
    FROM (SELECT *, CASE WHEN abs(apq) < 1e-300::DOUBLE THEN 0.0::DOUBLE ELSE (CASE WHEN h >= 0 THEN 1 ELSE -1 END) / (abs(h) + sqrt(h * h + 1)) END AS tan
    FROM (SELECT *, CASE WHEN abs(apq) < 1e-300::DOUBLE THEN 0.0::DOUBLE ELSE ({at('a', 'q', 'q')} - {at('a', 'p', 'p')}) / (2 * apq) END AS h
    FROM (SELECT *, {at('a', 'p', 'q')} AS apq FROM (SELECT t, a, v, l[t % len(l) + 1].p AS p, l[t % len(l) + 1].q AS q FROM turns, pairs WHERE t < {sweeps * d * (d - 1) // 2}))))))),
  done AS (SELECT a, v FROM turns ORDER BY t DESC LIMIT 1)"""


D = len(COLUMNS)
_COV = ", ".join(f'covar_samp("{a}", "{b}")' for a in COLUMNS for b in COLUMNS)
PCA = f"""{ZSCORED}, matrix AS MATERIALIZED (SELECT [{_COV}] AS a FROM z), {_jacobi(D, 9)},
  eigen AS (SELECT i, a[(i - 1) * {D} + i] AS value, list_transform(range(1, {D + 1}), lambda r: v[(r - 1) * {D} + i]) AS w FROM (SELECT unnest(range(1, {D + 1})) AS i, a, v FROM done)),
  ranked AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY value DESC) - 1)::INTEGER AS component, value, sum(value) OVER () AS every,
    list_transform(w, lambda x: CASE WHEN list_max(w) >= -list_min(w) THEN x ELSE -x END) AS w FROM eigen)"""


@query(f"{PCA} SELECT component, round(value, 6) AS eigenvalue, round(100 * value / sum(value) OVER (), 6) AS percent_of_retained, round(100 * value / every, 6) AS percent_of_all FROM ranked WHERE component < 8")
def pca_eigen(spark, sf):
    _, retained, every = _components(spark, sf)
    rows = [(i, float(v), float(100 * v / retained.sum()), float(100 * v / every.sum())) for i, v in enumerate(retained)]
    found = spark.createDataFrame(rows, "component int, eigenvalue double, percent_of_retained double, percent_of_all double")
    return found.select("component", *[six(c).alias(c) for c in found.columns[1:]])


_DOT = lambda c: " + ".join(f'"{n}" * w{c}[{i + 1}]' for i, n in enumerate(COLUMNS))


@query(f"{PCA}, axes AS (SELECT {', '.join(f'max(w) FILTER (component = {c}) AS w{c}' for c in range(8))} FROM ranked) SELECT read_idx, " + ", ".join(f"round({_DOT(c)}, 6) + 0.0::DOUBLE AS pc{c + 1}" for c in range(8)) + " FROM z, axes")
def pca_projection(spark, sf):
    return _components(spark, sf)[0].select("read_idx", *[six(F.col("x")[i]).alias(f"pc{i + 1}") for i in range(8)])


@query()
def kmeans(spark, sf):
    return matrix.k_means(_components(spark, sf)[0], 15)


def _lloyd(rounds: int, d: int) -> str:
    """Rounds over points (read_idx, x) from centroids c0 (cluster, c); a<rounds> holds the last assignment."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT read_idx, min({{'d': d, 'c': cluster}}).c AS cluster FROM (
    SELECT read_idx, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM points, c{i}) GROUP BY read_idx)""")
        means = ", ".join(f"sum(x[{j}]) / count(*)" for j in range(1, d + 1))
        parts.append(f"m{i} AS (SELECT cluster, [{means}] AS c FROM a{i} JOIN points USING (read_idx) GROUP BY cluster), c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return ", ".join(parts)


#: Whole numbers, so that sums are exact in any order.
STEP, FIRST, ROUNDS = 1000, 6, 5


@query(f""", w AS (SELECT read_idx, {GC} AS gc, length(seq) AS len FROM reads), points AS MATERIALIZED (SELECT read_idx, [floor(gc * {STEP}), len::DOUBLE] AS x FROM w),
  c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY read_idx) - 1)::INTEGER AS cluster, x AS c FROM points QUALIFY cluster < {FIRST}), {_lloyd(ROUNDS, 2)}
  SELECT read_idx, cluster FROM a{ROUNDS}""")
def kmeans_rounds(spark, sf):
    """Rounds of a fixed number from the first reads."""
    rows = matrix.features18(rd.reads(spark, sf)).select("read_idx", F.col("x")[0].alias("gc")).join(rd.reads(spark, sf).select("read_idx", F.length("seq").cast("double").alias("len")), "read_idx")
    points = rows.select("read_idx", F.array(F.floor(F.col("gc") * STEP).cast("double"), F.col("len")).alias("x"))
    start = np.array([r.x for r in points.orderBy("read_idx").limit(FIRST).collect()])
    return matrix.k_means(points, FIRST, max_rounds=ROUNDS, start=start)


@query(f"""{RAW}, points AS MATERIALIZED (SELECT read_idx, [{', '.join(f'"{c}"' for c in COLUMNS)}] AS x FROM raw), one AS (SELECT x AS first FROM points ORDER BY read_idx LIMIT 1),
  c0 AS MATERIALIZED (SELECT 0 AS cluster, first AS c FROM one UNION ALL SELECT 1, x FROM (SELECT x FROM points, one
    ORDER BY list_sum(list_transform(list_zip(x, first), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) DESC, read_idx LIMIT 1)), {_lloyd(20, D)}
  SELECT read_idx, cluster FROM a20""")
def two_means(spark, sf):
    return matrix.two_means(matrix.features18(rd.reads(spark, sf)))


@query()
def legacy_features(spark, sf):
    return matrix.legacy_features(rd.reads(spark, sf), 2, True).select("read_idx", F.size("x").alias("width"), six(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


CODONS = kmers.names(3)


@query(f"""{RAW}, t AS (SELECT read_idx, length(seq) // 3 AS n, substr(seq, 3 * unnest(range(0, length(seq) // 3)) + 1, 3) AS codon FROM reads),
  codons AS (SELECT read_idx, {', '.join(f"count(*) FILTER (codon = '{c}')::DOUBLE / n AS c_{c}" for c in CODONS)} FROM t GROUP BY read_idx, n)
  SELECT read_idx, {', '.join(f'round("freq_{n}", 6) + 0.0::DOUBLE AS "freq_{n}"' for n in NAMES)}, {', '.join(f'round(c_{c}, 6) + 0.0::DOUBLE AS c_{c}' for c in CODONS)}, round(gc, 6) + 0.0::DOUBLE AS gc
  FROM raw JOIN codons USING (read_idx)""")
def legacy_frequencies(spark, sf):
    """The k-mer, codon and GC columns of the legacy features."""
    x = matrix.legacy_features(rd.reads(spark, sf), 2, True)
    return x.select("read_idx", *[six(F.col("x")[i]).alias(n) for i, n in enumerate([*[f"freq_{n}" for n in NAMES], *[f"c_{c}" for c in CODONS], "gc"])])
