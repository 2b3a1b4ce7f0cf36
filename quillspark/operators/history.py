"""Revisions, snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def revision(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def page_history(revisions: DataFrame) -> DataFrame:
    """Each revision (path, ordinal, revision, status, successor) with its class against the one before; the first is added."""
    older = Window.partitionBy("path").orderBy("ordinal")
    lag = lambda c: F.lag(c).over(older)
    changed = T.lifecycle(lag("status"), F.col("status"), lag("successor"), F.col("successor"))
    return revisions.withColumn("class", F.when(F.row_number().over(older) == 1, "added").otherwise(changed))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, class) of keys (path, revision, status, successor, origin) that differ between two snapshots."""
    old, new = (f.select("path", *[F.col(c).alias(f"{p}_{c}") for c in ("revision", "status", "successor", "origin")], F.lit(True).alias(f"{p}_in")) for f, p in ((before, "o"), (after, "n")))
    met = old.join(new, "path", "full_outer")
    kind = (
        F.when(F.col("o_in").isNull(), "added")
        .when(F.col("n_in").isNull(), "effective_removed")
        .when(~F.col("o_origin").eqNullSafe(F.col("n_origin")), "origin_replaced")
        .when(~F.col("o_revision").eqNullSafe(F.col("n_revision")), T.lifecycle(F.col("o_status"), F.col("n_status"), F.col("o_successor"), F.col("n_successor")))
    )
    return met.select("path", kind.alias("class"), F.col("o_revision").alias("before"), F.col("n_revision").alias("after")).where("class IS NOT NULL")


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, from_uri, to_uri, relation): edges only before are removed, only after are added."""
    key = ["from_uri", "to_uri", "relation"]
    old, new = before.select(key).distinct(), after.select(key).distinct()
    return new.join(old, key, "left_anti").select(F.lit("added").alias("change"), *key).unionByName(old.join(new, key, "left_anti").select(F.lit("removed").alias("change"), *key))


def document_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of (path, digest, language): upsert where digest or language differ or the path is new, else delete."""
    old, new = previous.select("path", F.struct("digest", "language").alias("o")), current.select("path", F.struct("digest", "language").alias("n"))
    change = F.when(F.col("n").isNull(), "delete").when(~F.col("o").eqNullSafe(F.col("n")), "upsert")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def resource_changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(uri, change) of (uri, revision, origin): removed, updated or added."""
    old, new = known.select("uri", F.struct("revision", "origin").alias("o")), current.select("uri", F.struct("revision", "origin").alias("n"))
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(~F.col("o").eqNullSafe(F.col("n")), "updated")
    return old.join(new, "uri", "full_outer").select("uri", change.alias("change")).where("change IS NOT NULL")


def overlay(pages: DataFrame) -> DataFrame:
    """Of pages with one path the one whose source comes first (least precedence)."""
    first = Window.partitionBy("path").orderBy("precedence", "uri")
    return pages.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def keyset_page(pages: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The next pages by uri after a key."""
    return (pages if after is None else pages.where(F.col("uri") > after)).orderBy("uri").limit(limit)
