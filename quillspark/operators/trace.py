"""Agent runs and evidence records: budgets, gaps, completeness, latest versions, tombstones, learning from runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_budget(entries: DataFrame, most_entries: int, most_chars: int) -> DataFrame:
    """Entries (run_id, sequence, content) of each run up to the first that breaks a limit, with the run's continuation:
    the sequence of that first one, or null."""
    upto = Window.partitionBy("run_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (F.count("*").over(upto) > most_entries) | (F.sum(F.length("content").cast("long")).over(upto) > most_chars)
    marked = entries.withColumn("over", over)
    cut = marked.withColumn("continuation", F.min(F.when(F.col("over"), F.col("sequence"))).over(Window.partitionBy("run_id")))
    return cut.where("continuation IS NULL OR sequence < continuation").drop("over")


def gaps(entries: DataFrame) -> DataFrame:
    """(run_id, expected, found) where a sequence is not the one before plus one."""
    before = F.lag("sequence").over(Window.partitionBy("run_id").orderBy("sequence"))
    return entries.withColumn("expected", before + 1).where("sequence <> expected").select("run_id", "expected", F.col("sequence").alias("found"))


def completeness(entries: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(run_id, entries, complete): complete where sequences run from 0 without a gap and an outcome was recorded."""
    sums = entries.groupBy("run_id").agg(F.count("*").alias("entries"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count_distinct("sequence").alias("n"), F.max((F.col("kind") == outcome).cast("int")).alias("ended"))
    return sums.select("run_id", "entries", ((F.col("lo") == 0) & (F.col("hi") + 1 == F.col("n")) & (F.col("ended") == 1)).alias("complete"))


def diagnostics(entries: DataFrame) -> DataFrame:
    """(run_id, sequence, problem): tampered content and unreadable metadata."""
    bad = F.when(F.col("content_hash") != F.sha2("content", 256), "content_hash").when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), "malformed_record")
    return entries.select("run_id", "sequence", bad.alias("problem")).where("problem IS NOT NULL")


def latest(records: DataFrame) -> DataFrame:
    """The newest record by observed_at of each (kind, source_id), tombstones too; of equal times the least key."""
    first = Window.partitionBy("kind", "source_id").orderBy(F.desc("observed_at"), "key")
    return records.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def tombstones(latest_records: DataFrame, seen: DataFrame) -> DataFrame:
    """(kind, source_id) of live latest records that a complete listing (kind, source_id) no longer has."""
    return latest_records.where("NOT tombstone").join(seen.select("kind", "source_id").distinct(), ["kind", "source_id"], "left_anti").select("kind", "source_id")


def append_result(existing: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """New records with result created, unchanged (same content under the key) or conflict. Other columns do not matter."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    first = Window.partitionBy(*key).orderBy("digest")
    own = new.withColumn("digest", digest).withColumn("n", F.row_number().over(first)).withColumn("first", F.first("digest").over(first))
    old = existing.select(*key, digest.alias("old_digest"))
    met = own.join(old, key, "left")
    result = F.when(F.col("old_digest").isNull(), F.when(F.col("n") == 1, "created").when(F.col("digest") == F.col("first"), "unchanged").otherwise("conflict")).when(F.col("old_digest") == F.col("digest"), "unchanged").otherwise("conflict")
    return met.withColumn("result", result).drop("digest", "old_digest", "n", "first")


def learning(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, evidence, outcomes, attributions) of chosen runs: counts of entries, of outcomes, of knowledge uses."""
    chosen = entries.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return chosen.groupBy("run_id").agg(F.count("*").alias("evidence"), F.count_if(F.col("kind") == "outcome").alias("outcomes"), F.count("knowledge_uri").alias("attributions"))


def selected_runs(selections: list[tuple[str, str]], most: int = 20) -> list[str]:
    """Run ids, in order, of (run_id, learning_key) selections: each run once, one key for all."""
    if not 1 <= len(selections) <= most:
        raise ValueError(f"select between 1 and {most} runs")
    cleaned = sorted((r.strip(), k.strip()) for r, k in selections)
    if any(not r or not k for r, k in cleaned):
        raise ValueError("run_id and learning_key must not be empty")
    if len({r for r, _ in cleaned}) < len(cleaned):
        raise ValueError("a run is selected twice")
    if len({k for _, k in cleaned}) > 1:
        raise ValueError("the selected runs have other learning keys")
    return [r for r, _ in cleaned]


def learned(entries: DataFrame, runs: list[str], most: int = 200) -> dict[str, DataFrame]:
    """evidence, outcomes and attributions of complete runs, each by run and sequence, and procedure: (uri, revision).

    ``entries``: (run_id, sequence, kind, content, metadata, knowledge_uri, knowledge_revision, feedback). An incomplete
    run, more than ``most`` entries, an outcome without a boolean metadata.success, and several procedures (or none, with
    several runs) are errors."""
    chosen = entries.where(F.col("run_id").isin(*runs))
    state = {r["run_id"]: r for r in completeness(chosen).collect()}
    for run in runs:
        if run not in state or not state[run]["complete"]:
            raise ValueError(f"run {run!r} is incomplete")
    if sum(r["entries"] for r in state.values()) > most:
        raise ValueError(f"the selected evidence exceeds {most} entries")
    success = F.get_json_object("metadata", "$.success")
    supporting = F.when(success == "true", True).when(success == "false", False).otherwise(F.raise_error(F.concat(F.lit("an outcome needs a boolean metadata.success: run "), "run_id")).cast("boolean"))
    place, digest = ("run_id", "sequence"), F.sha2("content", 256).alias("digest")
    procedures = chosen.select(F.get_json_object("metadata", "$.procedure_uri").alias("uri"), F.get_json_object("metadata", "$.procedure_revision").alias("revision")).where("uri IS NOT NULL").distinct()
    named = procedures.limit(2).collect()
    if len(named) > 1 or not named and len(runs) > 1:
        raise ValueError("learning from several runs needs one procedure and revision")
    return {
        "evidence": chosen.select(*place, "kind", digest).orderBy(*place),
        "outcomes": chosen.where("kind = 'outcome'").select(*place, "content", supporting.alias("supporting")).orderBy(*place),
        "attributions": chosen.where("kind IN ('knowledge_use', 'feedback')").select(*place, F.col("knowledge_uri").alias("uri"), F.col("knowledge_revision").alias("revision"), "feedback").orderBy(*place),
        "procedure": procedures,
    }


def proposal(folded: dict[str, DataFrame], title: str, body: str) -> str:
    """A page that proposes what was learned: the given text, then outcomes for and against with the runs they come from."""
    rows = folded["outcomes"].collect()  # bounded by the number of entries that may be selected
    lines = [f"- {'supports' if r['supporting'] else 'contradicts'}: {' '.join(r['content'].split())} (run {r['run_id']}, entry {r['sequence']})" for r in rows]
    procedure = folded["procedure"].first()
    source = [f"Procedure: {procedure['uri']} at {procedure['revision']}", ""] if procedure else []
    return "\n".join([f"# {title}", "", body.strip(), "", *source, "## Outcomes", "", *lines, ""])
