"""Connected components of a distributed edge list, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import base

#: Up to so many edges (16 bytes each) are solved by one task at once; rounds over more of them are distributed.
FEW = 100_000


def _with_least(edges: DataFrame, total: int, stored: list[DataFrame]) -> DataFrame:
    """edges with m, the least of u and of all v that go with it, and n, their number. The minimum is combined before the shuffle, so a hub costs a row a task; the edges
    of hubs stay where they are. What is written for it is added to `stored`."""
    least = base.written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    stored.append(least)
    return base.join_counted(edges, least, ["u"], total)


def _large_star(edges: DataFrame, total: int, stored: list[DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total, stored).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int, stored: list[DataFrame]) -> DataFrame:
    down = base.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    stored.append(down)
    least = down.groupBy("u").agg(F.min("v").alias("v"))
    return _with_least(down, total, stored).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least).where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether these (u > v) are stars around their least nodes: each u has one v, and no v is a u."""
    if edges.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges in order, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while (apart := label[a] != label[b]).any():
        x, y = label[a[apart]], label[b[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches):
        found = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*map(np.concatenate, zip(*found, strict=True)))], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of (u, v) is connected with. Each round is written to the shared folder, and deleted after the next; rounds end when stars
    are left. A node that is in very many edges is no hot key (see join_counted). Up to FEW edges, also those that rounds leave, are solved without more rounds.

    Empty edges give no rows; loops, repeated edges and either direction don't matter; edges with a null end are left out."""
    ends = (F.col("u").cast("long"), F.col("v").cast("long"))
    some = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
    now = base.written(some.distinct())
    base.ship(edges.sparkSession)
    while (total := now.count()) > FEW and not _done(now):
        stored = [now]
        now = base.written(_small_star(_large_star(now, total, stored), total, stored))
        for frame in stored:
            base.dropped(frame)
    if total <= FEW:
        solved = base.written(_at_once(now))
        base.dropped(now)
        return solved
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
