"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.store import discard, materialize

#: Links (16 bytes each) up to which one task finds the components, once they are counted; beyond it rounds over tables do.
ONE_TASK_LINKS = 1_000_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = root(u), root(v)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, root: for each node of a link, the smallest node it can reach.

    Alternating large-star and small-star rounds (each halves the depth of the
    trees, about).  Every round is a written table; what meets at a hub is a
    minimum, computed by partial aggregation, and joined back.
    """
    both = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u != v")
    edges = materialize(both.distinct(), "links")  # v > u: v points to u
    if edges.count() <= one_task:
        return materialize(edges.coalesce(1).mapInArrow(_union_find, "node long, root long"), "components")
    while True:
        # large star: every larger neighbour of a node is linked to the smallest of its neighbourhood
        around = edges.select(F.col("v").alias("n"), F.col("u").alias("x")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("x")))
        least = around.groupBy("n").agg(F.least(F.min("x"), F.first("n")).alias("m"))
        large = around.join(least, "n").filter("x > n").select(F.col("x").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        new = materialize(small.filter("v != u").distinct(), "links")
        same = new.join(edges, ["v", "u"]).count()
        done = same == new.count() == edges.count()
        discard(edges)
        edges = new
        if done:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
