"""Connected components of an edge table, by contraction in tasks and pointer jumping.

Edges (u, v) point from a larger node to a smaller one. Each round joins what the edges of one task connect (union-find,
edges to the least node at hand): first as the table is read, so that a node has at most one edge a task, then with all
edges up from a node in one task. Then each edge jumps to the least parent of its upper end, a minimum by node
(pre-aggregated) and a join. So a node with a third of all edges is neither gathered in one group nor sent to one task.
Rounds end when each node has one edge, to the least node of its component."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tables import partitions, removed, written

#: Edges that a task contracts at once, so that its memory stays bounded.
EDGES = 1 << 20
EDGE = "u long, v long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> edges from each node to the least node that the edges at hand connect it with."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, root(x)) for x in list(up)]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found if f[0] != f[1]], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
        if len(up) > EDGES:
            yield stars()
            up.clear()
    yield stars()


def _round(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    near = edges.mapInArrow(_contract, EDGE)
    hooked = near.repartition(partitions(spark), "u").mapInArrow(_contract, EDGE)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    return hooked.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge up, or is the upper end of edges only."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("down").alias("top")).where("ups > 1 OR ups = 1 AND top = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v) that is not the least of its component."""
    now = written(_round(edges.select("u", "v").where("u <> v")), "stars")
    while not _done(now):
        now, last = written(_round(now), "stars"), now
        removed(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
