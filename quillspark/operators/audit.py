"""Rule-based audit: one frame of findings a class, all with the same columns.

Columns: class, classification (authored, fact or candidate), severity, confidence, author_decision (whether an author is
to decide), uris (array, sorted), evidence (array of strings). Filters restrict which pages are reported; links are always
taken from all pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import times
from quillspark.operators import graph, paging, ranks

RETIRED = ("archived", "retired")
#: Pages that one finding names; a group of more is several findings, each with the next of its pages.
MEMBERS = 10_000
SEVERITIES = ("high", "medium", "low")


def _found(frame: DataFrame, name: str | Column, classification: str, severity: str | Column, uris: Column, evidence: Column, confidence: str = "high") -> DataFrame:
    name, severity = (F.lit(c) if isinstance(c, str) else c for c in (name, severity))
    facts = (name.alias("class"), F.lit(classification).alias("classification"), severity.alias("severity"), F.lit(confidence).alias("confidence"))
    return frame.select(*facts, F.lit(classification == "candidate").alias("author_decision"), F.array_sort(uris).alias("uris"), evidence.alias("evidence"))


def selected(pages: DataFrame, types: tuple[str, ...] = (), tiers: tuple[str, ...] = ()) -> DataFrame:
    if types:
        pages = pages.where(F.col("type").isin(*types))
    return pages.where(F.col("tier").isin(*tiers)) if tiers else pages


def authored(pages: DataFrame) -> DataFrame:
    """Stale, incorrect and duplicate marks, and marks whose target resolves to nothing.

    ``pages``: (uri, maintenance: array of structs kind, reason, target, target_uri)."""
    marks = pages.select("uri", F.inline("maintenance"))
    names = F.concat(F.lit("authored_"), F.col("kind"))
    severity = F.when(F.col("kind") == "incorrect", "high").otherwise("medium")
    uris = F.array_compact(F.array("uri", "target_uri"))
    own = _found(marks, names, "authored", severity, uris, F.array("reason"))
    broken = marks.where("target IS NOT NULL AND target_uri IS NULL")
    return own.unionByName(_found(broken, "broken_maintenance_target", "fact", "high", F.array("uri"), F.array("target")))


def orphans(pages: DataFrame, edges: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """Pages that nothing links to, but for Concept pages and entry points (uri)."""
    kept = pages.where(~F.col("type").eqNullSafe(F.lit("Concept"))).join(edges.select(F.col("to_uri").alias("uri")), "uri", "left_anti")
    if entry_points is not None:
        kept = kept.join(entry_points, "uri", "left_anti")
    return _found(kept, "orphan", "fact", "medium", F.array("uri"), F.array(F.lit("0")))


def superseded(succession: DataFrame, trust: DataFrame, reported: DataFrame | None = None, hops: int = 32) -> DataFrame:
    """Successors that resolve to nothing, cycles, and successors that are retired or succeeded themselves.

    ``succession``: (uri, next, authored) of all pages; ``trust``: (uri, status); ``reported``: (uri) restricts the findings.
    Only a page whose own successor is not there is broken, not those before it. Pages that lead into one cycle from
    outside it give a finding of their own, as their way is another; a page on such a way is not judged further."""
    own = succession.where("authored IS NOT NULL")
    if reported is not None:
        own = own.join(reported.select("uri"), "uri", "left_semi")
    broken = _found(own.where("next IS NULL"), "broken_supersession", "fact", "high", F.array("uri"), F.array("authored"))
    cyclic = graph.supersession(succession, hops).where("status = 'cycle'").join(own.where("next IS NOT NULL").select("uri"), "uri", "left_semi")
    members = F.when(F.element_at("chain", 1) == F.element_at("chain", -1), F.slice("chain", 1, F.size("chain") - 1)).otherwise(F.col("chain"))
    ways = cyclic.select(F.array_sort(members).alias("members")).distinct()
    loops = _found(ways, "cyclic_supersession", "fact", "high", F.col("members"), F.col("members"))
    facts = succession.select(F.col("uri").alias("next"), F.col("authored").alias("n_authored")).join(trust.select(F.col("uri").alias("next"), "status"), "next", "left")
    met = own.join(cyclic.select("uri"), "uri", "left_anti").join(facts, "next").where(F.col("status").isin(*RETIRED) | F.col("n_authored").isNotNull())
    later = _found(met, "non_current_supersession", "fact", "high", F.array("uri", "next"), F.array(F.coalesce("status", F.lit(""))))
    return broken.unionByName(loops).unionByName(later)


def retired_references(edges: DataFrame, trust: DataFrame, retired: tuple[str, ...] = RETIRED) -> DataFrame:
    """Pages not retired that refer to a retired one, for each relation but succession."""
    status = lambda side: trust.select(F.col("uri").alias(f"{side}_uri"), F.col("status").alias(f"{side}_status"))
    named = edges.where("relation <> 'superseded_by'").select("from_uri", "to_uri", "relation").distinct()
    met = named.join(status("to").where(F.col("to_status").isin(*retired)), "to_uri").join(status("from"), "from_uri", "left")
    hit = met.where(~F.coalesce(F.col("from_status").isin(*retired), F.lit(False)))
    return _found(hit, "active_reference_retired", "fact", "high", F.array("from_uri", "to_uri"), F.array("from_uri", "relation", "to_uri", "to_status"))


def duplicate_identities(pages: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Two or more pages of one type with one normalised title or alias, unless one is marked (from_uri, to_uri) as the
    other's duplicate. A group of more than MEMBERS pages is several findings."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = pages.select("uri", "type", F.explode(names).alias("name")).select("uri", "type", T.identity(F.col("name")).alias("identity")).where("identity <> ''").distinct()
    groups = ranks.parts_of(keyed, ["type", "identity"], "uri", MEMBERS).where("size > 1").withColumnRenamed("members", "uris")
    if marked is not None:
        pairs = marked.select("from_uri", "to_uri")
        member = keyed.select("type", "identity", F.col("uri").alias("from_uri")).join(pairs, "from_uri").join(keyed.select(F.col("type").alias("t2"), F.col("identity").alias("i2"), F.col("uri").alias("to_uri")), "to_uri")
        groups = groups.join(member.where("t2 <=> type AND i2 = identity").select("type", "identity").distinct(), ["type", "identity"], "left_anti")
    return _found(groups, "duplicate_identity", "candidate", "low", F.col("uris"), F.array("identity"), "medium")


def tag_fragments(pages: DataFrame) -> DataFrame:
    """Tags that differ in spelling only, with the pages that have them; more than MEMBERS pages are several findings."""
    tags = pages.select("uri", F.explode("tags").alias("tag")).withColumn("normal", T.identity(F.col("tag"))).where("normal <> ''")
    # spellings are counted in tasks first; pages come in ranked parts, so a common tag is no single row
    spelled = tags.select("normal", "tag").distinct().groupBy("normal").agg(F.array_sort(F.collect_list("tag")).alias("spellings")).where(F.size("spellings") > 1)
    groups = ranks.parts_of(tags, ["normal"], "uri", MEMBERS).withColumnRenamed("members", "uris").join(spelled, "normal")
    return _found(groups, "tag_fragmentation", "candidate", "low", F.col("uris"), F.col("spellings"))


def ambiguities(pages: DataFrame) -> DataFrame:
    """Pages with claims (array of structs kind, line, column) that are marked ambiguous."""
    marked = pages.withColumn("hits", F.filter("claims", lambda c: c["kind"] == "ambiguous")).where(F.size("hits") > 0)
    return _found(marked, "ambiguity", "candidate", "medium", F.array("uri"), F.transform("hits", lambda c: F.concat_ws(":", c["line"].cast("string"), c["column"].cast("string"))))


def contradictions(edges: DataFrame) -> DataFrame:
    """Pairs of pages one of which contradicts the other, each pair once."""
    pairs = edges.where("relation = 'contradicts'").select(F.least("from_uri", "to_uri").alias("a"), F.greatest("from_uri", "to_uri").alias("b")).distinct()
    return _found(pairs, "contradiction", "candidate", "high", F.array("a", "b"), F.array(F.lit("contradicts")))


def contradiction_lists(edges: DataFrame) -> DataFrame:
    """(uri, others): for each page the pages on the other side, from both ends."""
    flat = edges.where("relation = 'contradicts'").select(F.col("from_uri").alias("uri"), F.col("to_uri").alias("other"))
    return flat.unionByName(flat.select(F.col("other").alias("uri"), F.col("uri").alias("other"))).groupBy("uri").agg(F.array_sort(F.collect_set("other")).alias("others"))


def stale(pages: DataFrame, now: str, after: str) -> tuple[DataFrame, DataFrame]:
    """Findings of pages older than a duration at a given time, with the field that tells it, and (uri, reason) of pages
    without a readable time."""
    fields = ("observed_at", "valid_until", "valid_from", "occurred_at", "committed_at")
    field = F.coalesce(*[F.when(times.instant_or_date(F.col(c)).isNotNull(), F.lit(c)) for c in fields])
    aged = pages.withColumns({"seen": times.staleness_time(*[F.col(c) for c in fields]), "seen_in": field})
    limit = times.seconds_of(after)
    old = aged.where(F.lit(now).cast("timestamp").cast("double") - F.col("seen").cast("double") > limit)
    unknown = aged.where("seen IS NULL").select("uri", F.lit("timestamp_unknown").alias("reason"))
    return _found(old, "stale", "candidate", "medium", F.array("uri"), F.array(F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "seen_in")), unknown


def finding_id(frame: DataFrame) -> DataFrame:
    return frame.withColumn("id", F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct("class", "uris", "evidence")), 256)))


def _order() -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return [rank, F.array_join("uris", "\0"), F.col("class"), F.col("id")]


def ordered(*findings: DataFrame) -> DataFrame:
    """All findings with ids, in order: severity, uris, class, id."""
    return finding_id(reduce(DataFrame.unionByName, findings)).orderBy(*_order())


def listed(*findings: DataFrame) -> ranks.Listing:
    """All findings with ids, stored once in that order, for pages at any place."""
    return ranks.listing(finding_id(reduce(DataFrame.unionByName, findings)), _order())


def page(findings: DataFrame | ranks.Listing, snapshot: str, request: dict, limit: int = 100, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of the findings in order and the next page's cursor, bound to the pages' digest and the request."""
    return paging.by_offset(findings, _order(), "audit", snapshot, request, limit, cursor)


def snapshot_digest(pages: DataFrame) -> DataFrame:
    """One digest for a set of pages (uri, revision). Per-page digests are hashed in 4,096 parts, then the parts."""
    lines = pages.select(F.sha2(F.concat("uri", F.lit("\0"), "revision"), 256).alias("line"))
    parts = lines.groupBy(F.substring("line", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    return parts.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", "d"))), "\n"), 256)).alias("digest"))
