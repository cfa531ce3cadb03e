"""The block matrix join against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import ann


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, [math.inf]), [float(x) for x in v])
    out = []
    for q, v in good.items():
        if q % every == 0:
            found = sorted((-(np.array(v) * np.array(w)).sum(), i) for i, w in good.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, k, every):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, side int, dim int").repartition(3)
    return sorted(map(tuple, ann.neighbours(df, F.col("vec_id") % every == 0, k).collect()))


def vectors(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, np.float32(rng.normal(size=dim) * scale * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "k"), [(300, 16, 5), (40, 64, 20), (12, 3, 20)])
def test_exact(spark, n, dim, k):
    rows = vectors(n, n, dim)
    assert run(spark, rows, k, 5) == brute(rows, k, 5)


def test_many_cells(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 16), ("SHARD", 64), ("TILE_ROWS", 4), ("TILE_COLUMNS", 16)):
        monkeypatch.setattr(ann, name, value)
    rows = vectors(7, 400, 8)
    assert run(spark, rows, 7, 4) == brute(rows, 7, 4)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0]), (10, [0.0, 2.0]), (20, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(1, [1.0, 0.0]), (10, [0.0, 3.0])]
    got = run(spark, rows, 3, 10)
    assert got == brute(rows, 3, 10)
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 10, 0.0)]
    assert run(spark, [], 3, 10) == [] and run(spark, rows[:1], 3, 10) == []


def test_smallest_numbers_and_doubles(spark):
    tiny = 5e-324
    rows = [(20, [tiny, -tiny]), (0, [tiny, 0.0]), (1, [tiny * 3, -tiny]), (2, [1e300, 1e-300]), (3, [0.1, 0.2]), (10, [0.3, tiny])]
    block = ann.Block(np.arange(6), np.array([v for _, v in rows]))
    assert not np.isnan(block.error).any() and (block.scale > 0).all()
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score double")
    assert sorted(map(tuple, ann.neighbours(df, F.col("vec_id") % 10 == 0, 3).collect())) == brute(rows, 3, 10)


def test_wide_vectors_stay_exact():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 3000)), rng.normal(size=(40, 3000))
    estimate, bound = ann.tile(ann.Block(np.arange(5), a), slice(0, 5), ann.Block(np.arange(40), b), slice(0, 40))
    assert (np.abs(estimate - a @ b.T) <= bound).all()
