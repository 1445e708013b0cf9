"""Ball k-means against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from seqloom.llm import ball_kmeans as bk
from seqloom.llm.queries import ORACLES, op13_ball_kmeans
from tests import compare


def brute(rows, clusters=40, rounds=5, dimensions=64, scale=256):
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], object)
    c = np.array([v for _, v in order[:clusters]], object)
    apart = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = apart().argmin(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].sum(axis=0) // int((own == i).sum())
    d = apart()
    own, least = d.argmin(axis=1), d.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted((i or 0, int(a), int(n), int(least[own == a].sum()), int(least.sum()), sha[a]) for (i, _), a, n in zip(kept, own, least))


def got(df, **options):
    return sorted((r.vec_id or 0, *r[1:]) for r in bk.ball_kmeans(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_against_duckdb(spark):
    assert compare.differences(spark, op13_ball_kmeans, ORACLES["op13_ball_kmeans"], "/root/testdata/sf0.001") == []


@pytest.mark.parametrize("every", [1, 2, 8])
def test_ties_on_a_grid(spark, every):
    """Small whole numbers give many equal distances; clusters are written to the folder after one, two or no rounds."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 3, 3).astype(float).tolist()) for i in range(300)]
    assert got(frame(spark, rows), clusters=9, dimensions=3, scale=1, every=every) == brute(rows, 9, 5, 3, 1)


def test_groups_apart_and_large_components(spark):
    rng = np.random.default_rng(2)
    for size in (1.0, 5e4):
        rows = [(i, (rng.normal(0, 0.02, 4) + rng.integers(0, 5, 4) * size).tolist()) for i in range(400)]
        assert got(frame(spark, rows), clusters=12, dimensions=4) == brute(rows, 12, 5, 4)
    with pytest.raises(Exception, match="too large"):
        got(frame(spark, [(1, [1e9, 0.0])]), dimensions=2)


def test_odd_rows(spark):
    v = lambda *x: [*map(float, x)] * 32
    rows = [(1, v(0, 1)), (1, v(0, 1)), (2, v(-0.5, 3)), (None, v(4, 4)), (3, None), (4, []), (5, v(1, 1)[:63]), (6, [*v(1, 1)[:63], None]), (7, [*v(1, 1)[:63], float("nan")]), (8, [*v(1, 1)[:63], float("inf")]), (1, v(9, 9)), (9, v(-0.001, 0.003))]
    df = frame(spark, rows)
    extra = df.selectExpr("*", "1 as cluster", "'a' as distance", "2 as x")
    assert got(df) == got(extra) == brute(rows)
    assert got(df, clusters=2) == brute(rows, 2)
    assert got(df.limit(0)) == [] and got(df.where("vec_id in (3, 4, 5)")) == []
    assert bk.ball_kmeans(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_balls_compare_less_than_all():
    """Far groups: most centroids are no neighbours, and members within half the way to the nearest are in the core."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-4000, 4000, (30, 8))
    x = (centers[rng.integers(0, 30, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.float64)
    first = bk.nearest(x, centers)
    radii = [int(bk.root_above(int(bk.squared(x[first == c], centers[c]).max(initial=0)))) for c in range(30)]
    model = bk.balls(centers, radii)
    assert sum(len(n) for n, _ in model.neighbours) < 30
    moved = centers + rng.integers(-25, 25, centers.shape)
    model = bk.balls(moved, [r + 80 for r in radii])
    assert (bk.move(x, first, model) == bk.nearest(x, moved)).all()
