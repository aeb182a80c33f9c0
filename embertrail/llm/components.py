"""Connected components of an edge table.

Up to LOCAL edges (a bound that is checked) one task joins them with union-find. Larger tables are first contracted partition by
partition the same way, then go through alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ready, release

#: Edges that one task takes: 16 bytes each, and a dictionary of their nodes.
LOCAL = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (node, least node that it reaches by these edges), for every node of theirs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(n) for n in nodes], np.int64))], ["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least one it knows."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """edges (a, b) -> node, component: the least node that it reaches. Nodes without edges to others are not listed; every step is
    written to the shared folder, so a lost executor costs no more than the step."""
    ready(edges.sparkSession)
    now = materialise(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    n = now.count()
    if n <= local:
        out = materialise(now.coalesce(1).mapInArrow(_contract, "node long, component long"), "components")
        release(now)
        return out
    now, before = materialise(now.mapInArrow(_contract, "node long, component long").where("node <> component").toDF("a", "b").distinct(), "edges"), now
    release(before)
    state = _state(now)
    while state[0]:
        now, before = materialise(_small_star(_large_star(now)), "edges"), now
        release(before)
        if (new := _state(now)) == state:
            break
        state = new
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b"), F.col("b")).distinct()), "components")
    release(now)
    return out
