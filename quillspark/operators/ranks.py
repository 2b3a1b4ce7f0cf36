"""Ranks and pages of large ordered results, without a window or a sort in one task.

Rows are dealt out by ranges of their order, sorted inside each range and written once; with the number of rows that each
range has (of each group), a row's rank is its place in its range plus what comes before. Equal rows in the order are told apart by
``order`` itself: end it with something unique, or a value that many rows share sends them all to one range."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import graph


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rk_part and rk_place, the range and the place in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({f"rk_{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"rk_{i}").asc_nulls_first() for i in range(len(order))]
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*[f"rk_{i}" for i in range(len(order))])
    told = dealt.withColumn("rk_place", F.monotonically_increasing_id())
    return told.withColumns({"rk_part": F.shiftright("rk_place", 33), "rk_place": F.col("rk_place").bitwiseAND(F.lit((1 << 33) - 1))})


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with rank (from 0) in their group by ``order``, and size, the group's number of rows."""
    dealt = graph.written(_ranges(rows, [*map(F.col, group), *map(F.col, order)]))
    named = [F.col(g).alias(f"rk_g{i}") for i, g in enumerate(group)]
    counts = dealt.groupBy(*named, F.col("rk_part").alias("rk_p")).agg(F.min("rk_place").alias("rk_first"), F.count("*").alias("rk_n"))
    # a row a range and group: a group's window has at most as many rows as there are ranges
    own = Window.partitionBy(*[f"rk_g{i}" for i in range(len(group))])
    before = own.orderBy("rk_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = graph.written(counts.withColumns({"rk_before": F.sum("rk_n").over(before) - F.col("rk_n"), "size": F.sum("rk_n").over(own)}))
    same = F.col("rk_part") == F.col("rk_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"rk_g{i}"))
    return dealt.join(starts, same).withColumn("rank", F.col("rk_place") - F.col("rk_first") + F.col("rk_before")).select(*rows.columns, "rank", "size")


def parts_of(members: DataFrame, group: list[str], member: str, most: int) -> DataFrame:
    """(group, part, size, members): each group's distinct members in order, at most ``most`` in a row, so that a group with a
    third of all members is many rows, made in many tasks."""
    placed = ranked(members.select(*group, member).distinct(), group, [member])
    rows = placed.groupBy(*group, F.floor(F.col("rank") / most).alias("part")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(member)).alias("members"))
    return rows


@dataclass
class Listing:
    """Rows in order, stored by ranges; ``starts`` is the rank at which each range begins, and the number of rows at its end."""

    rows: DataFrame
    starts: list[int]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows from ``offset`` on, in order: only the ranges that hold them are read."""
        last = min(offset + limit, self.total)
        first = max(bisect_right(self.starts, offset) - 1, 0)
        held = [k for k in range(first, len(self.starts) - 1) if self.starts[k] < last and self.starts[k + 1] > offset]
        begins = F.coalesce(*[F.when(F.col("rk_part") == k, self.starts[k]) for k in held], F.lit(0)) if held else F.lit(0)
        found = self.rows.where(F.col("rk_part").isin(held)).withColumn("rk_rank", F.col("rk_place") + begins)
        return found.where((F.col("rk_rank") >= offset) & (F.col("rk_rank") < last)).orderBy("rk_rank").drop("rk_rank", "rk_part", "rk_place")


def listing(rows: DataFrame, order: list[Column | str]) -> Listing:
    """Stores rows once, by ranges of their order, so that each page costs what its own ranges hold."""
    spark = rows.sparkSession
    path = f"{graph.shared(spark)}/listing-{uuid.uuid4().hex}"
    _ranges(rows, [F.col(c) if isinstance(c, str) else c for c in order]).write.partitionBy("rk_part").parquet(path)
    held = spark.read.parquet(path) if not rows.isEmpty() else rows.withColumns({"rk_place": F.lit(0).cast("long"), "rk_part": F.lit(0)})
    sizes = {r["rk_part"]: r["n"] for r in held.groupBy("rk_part").agg(F.count("*").alias("n")).collect()}  # a row a range
    starts = [0]
    for k in range(max(sizes, default=-1) + 1):
        starts.append(starts[-1] + sizes.get(k, 0))
    return Listing(held.select(*rows.columns, "rk_part", "rk_place"), starts)
