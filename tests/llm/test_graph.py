from __future__ import annotations

import random

import numpy as np
import pytest

from gaugework.llm import base, graph
from gaugework.llm.graph import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges += [(7, 7), (1, 0), (None, 3), (9999, 9999)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(root))
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_hubs(spark, monkeypatch):
    """A node in very many edges, the least of its component or not: hot keys are joined by broadcast, with the same result."""
    monkeypatch.setattr(base, "HOT", 10**9)
    edges = [(5000, i) for i in range(2, 1500)] + [(0, 7000 + i) for i in range(1500)] + [(1499, 1499 + 7000), (20_000, 20_001)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()))
    assert got.pop(20_000) == got.pop(20_001) == 20_000
    assert set(got) == {0, 5000, *range(2, 1500), *range(7000, 8500)} and set(got.values()) == {0}


@pytest.mark.parametrize("few", [0, 30, 10**6])
def test_few_edges_take_no_rounds(spark, monkeypatch, few):
    """In rounds, in some rounds and then at once, or at once: the same result."""
    monkeypatch.setattr(graph, "FEW", few)
    rounds = []
    star = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda *a: rounds.append(1) or star(*a))
    test_components(spark)
    test_hubs(spark, monkeypatch)
    assert bool(rounds) == (few < 10**6)


def test_roots_of_long_paths():
    rng = np.random.default_rng(4)
    name = rng.permutation(20_000)
    nodes, root = graph.roots(name[:-1], name[1:])
    assert nodes.tolist() == list(range(20_000)) and not root.any()
