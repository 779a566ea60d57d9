"""Centroid clustering with adaptive bounds against a plain loop over all distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import clustering, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, dim, scale=256, seed=2):
    """id, cluster, distance of every kept vector, by definition."""
    kept = [(i, tuple(np.float32(x) for x in v)) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    ints = lambda v: [int(np.floor(float(x) * scale)) for x in v]
    centers = [ints(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    vectors = [(i, ints(v)) for i, v in kept]
    for at in range(rounds + 1):
        best = [min((far(v, c), j) for j, c in enumerate(centers)) for _, v in vectors]
        if at == rounds:
            return [(i, j, d) for (i, _), (d, j) in zip(vectors, best)], centers
        for j in range(len(centers)):
            mine = [v for (_, v), (_, c) in zip(vectors, best) if c == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]


def same(spark, rows, k=7, rounds=4, dim=3, partitions=3):
    got = clustering.cluster(spark.createDataFrame(rows, SCHEMA).repartition(partitions), k=k, rounds=rounds, dim=dim)
    want, centers = plain(rows, k, rounds, dim)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.rows.collect()), key=repr) == sorted(want, key=repr) and got.centers == centers
    assert got.inertia == [sum(d for _, c, d in want if c == j) for j in range(len(centers))]
    return got


@pytest.mark.parametrize("seed", range(3))
def test_against_all_distances(spark, seed):
    r = np.random.default_rng(seed)
    at = r.integers(0, 9, 400)
    rows = [(int(i), (r.normal(size=3) * 0.2 + [a % 3, a // 3, 1]).tolist(), 0) for i, a in enumerate(at)]
    got = same(spark, rows)
    assert got.scans[0] == 400 and min(got.scans[1:]) < 300  # bounds spare scans


def test_ties_and_repeats(spark):
    """Lattice points: many equal distances, repeated vectors and ids; the smaller number wins without any bound deciding."""
    r = np.random.default_rng(5)
    rows = [(int(i) // 2, [float(x) / 256 for x in r.integers(-2, 3, 3)], 0) for i in range(300)]
    rows += [(7, [0.0, 0.0, 0.0], 0)] * 200
    same(spark, rows, k=12, rounds=5)


def test_wide_components(spark):
    r = np.random.default_rng(6)
    same(spark, [(int(i), [float(x) for x in r.integers(-(2**17), 2**17, 3)], 0) for i in range(60)], k=5)
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame([(1, [1e30, 0.0, 0.0], 0)], SCHEMA), dim=3)


def test_odd_vectors(spark):
    good = [(i, [float(i), 1.0, -0.5], None) for i in range(4)]
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, 2.0], 1), (93, [1.0, None, 2.0], 1), (94, [1.0, float("nan"), 2.0], 1), (95, [float("inf"), 0.0, 0.0], 1)]
    null = [(None, [0.25, 1.0, 0.0], 0)]
    got = same(spark, good + bad + null, k=40)  # fewer vectors than clusters
    assert len(got.centers) == 5
    df = spark.createDataFrame(good, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "cluster", "x", "sums")})
    assert clustering.cluster(df, k=2, dim=3).rows.count() == 4
    none = clustering.cluster(spark.createDataFrame(bad, SCHEMA), dim=3)
    assert none.rows.count() == 0 and none.rows.columns == ["id", "cluster", "distance"]


def test_empty_query(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["op13_clustering"](spark, str(tmp_path)).count() == 0


def test_bounds_hold(spark):
    """After moves, every bound is on the right side of the exact distance."""
    r = np.random.default_rng(8)
    x, c = r.integers(-50, 50, (200, 8)), r.integers(-50, 50, (12, 8))
    known = clustering.Bounds.scanned(x, c, 4)
    for _ in range(4):
        new = c + r.integers(-6, 7, c.shape)
        known, _, _ = known.trimmed(3).after(clustering._above(clustering._paired(new, c))).settled(x, new)
        c = new
        d = np.sqrt(clustering._squared(x, c).astype(float))
        assert (known.cluster == d.argmin(1)).all() and (known.upper >= d[np.arange(200), known.cluster]).all()
        assert (known.low <= np.take_along_axis(d, known.near, 1)).all()
        others = np.ones(d.shape, bool)
        others[np.arange(200), known.cluster] = False
        np.put_along_axis(others, known.near, False, 1)
        assert (known.rest <= np.where(others, d, np.inf).min(1)).all()
