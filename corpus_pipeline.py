"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir), decides, and returns the columns of documents; the last returns the packed pieces.
``run`` writes each stage's rows as Parquet in the shared folder and rereads them as the next one's docs, so a lost
executor costs no more than the stage at work. SQL cannot express the stages (a fitted classifier, tokenizer ids), so
tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, neardup, packing, personal, quality
from quillspark.llm.tables import held, released, table, written


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of the best grade is too small. The classifier learns from labels of these documents.

    A null text is judged as an empty one. Null and repeated doc_ids are judged by their texts like any other; equal texts
    share one fate. Where labels tell nothing apart, all stay. An empty table stays empty; all columns stay."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return released(quality.score(held(docs, "text"), model).where("keep"), docs, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates (five words, similarity 0.8): that with the least doc_id.

    Documents without words link with nothing and stay. Null doc_ids come last in a component, and of them the least text
    hash stays; of rows with one doc_id and one text one stays; another text under a doc_id is a document of its own. Very
    long texts count whole. An empty table stays empty; all columns stay."""
    return neardup.without_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text, and counts its characters anew (n_chars, where there is such a column).

    A null text stays null with its count. Equal texts get equal results, whatever their doc_ids; overlapping spans become
    one. Very long texts are searched whole. An empty table stays empty; no row goes and all columns stay."""
    changed = personal.redact(docs, personal.learn(docs))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own. Null and repeated doc_ids draw by source and text; rows equal in all three share one
    draw. Documents without words have no size and are taken as their source's rate says. Texts are taken whole, however
    long. An empty table stays empty; all columns stay."""
    used = ("doc_id", "source", "text")
    mixed = mixing.mixed(held(docs, *used)).where("copies > 0")
    return released(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs, *used)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents (a copy is a document of its own) with their places in sequences.

    A null or empty text is one piece of the closing id. Repeated rows are packed one by one; ties in length are ranked by
    doc_id and piece, null doc_ids first. Very long texts are cut into full pieces. An empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
