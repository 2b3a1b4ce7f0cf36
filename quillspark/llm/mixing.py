"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counted in words and added up by source before anything is joined. The targets level off by weight: a source
gets ``level * weight``, or its cap (``most`` times its own size) where that is less, with the level at which all
targets add up to all sizes. That is where resharing the excess by weight ends. Each document is then taken
floor(rate) times, rate = target / source size, and once more if a draw seeded by its doc_id, source and text lies under
the fraction. The targets need one row a source in one task; documents are never sorted or gathered.

Defined results: a null or wordless text has size 0 and taken 0; a null source is a source of its own, last in order; a
null doc_id draws by source and text, and so do other texts under one doc_id; rows equal in all three draw alike; a very
long text is taken whole or not at all; other columns stay, but for those
named like a result, which are replaced; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.tables import table

WEIGHTS, MOST = (1, 2, 3), 3
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, source: Column, text: Column) -> Column:
    """A number in [0, 1) from a hash of the three; a null is told from an empty text."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(source), F.lit("-")), F.coalesce(F.md5(text), F.lit("-")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) of each source -> with weight and target. One row a source: windows over sources are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    # with this and all sources of lower caps at their caps, the level of the rest; the first k whose rest is under its cap counts
    summed = weighed.withColumns({"all_size": F.sum("source_size").over(everything), "before": F.sum("source_size").over(by_cap) - F.col("source_size"), "rest": F.sum("weight").over(everything) - F.sum("weight").over(by_cap) + F.col("weight")})
    level = (F.col("all_size") - most * F.col("before")).cast("double") / F.col("rest").cast("double")
    return (
        summed.withColumn("level", level)
        .withColumn("fits", F.col("level") * F.col("weight") <= (most * F.col("source_size")).cast("double"))
        .withColumn("final", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("final") * F.col("weight"), (most * F.col("source_size")).cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, rate and copies (how often the mix takes the document). Columns
    of these names that ``docs`` has are replaced; ``tables.held`` keeps them."""
    named = docs.drop("size", "source_size", "target", "rate", "copies", "mix_source")
    sized = named.withColumn("size", size_of(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(sums, weights, most).select(F.col("source").alias("mix_source"), "source_size", "target")
    joined = sized.join(found, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    whole = F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", whole + F.when(draw(F.col("doc_id"), F.col("source"), F.col("text")) < F.col("rate") - whole, 1).otherwise(0))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(source), '-') || ':' || coalesce(md5(text), '-')) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
summed AS (SELECT *, sum(source_size) OVER () AS all_size,
  sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - source_size AS before,
  sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS rest FROM weighed),
levels AS (SELECT *, (all_size - 3 * before)::DOUBLE / rest::DOUBLE AS level FROM summed),
final AS (SELECT max(level) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (SELECT source, source_size, least(final.level * weight, (3 * source_size)::DOUBLE) AS target FROM levels, final),
rated AS (SELECT doc_id, key, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN
  ('0x' || substr(key, 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
