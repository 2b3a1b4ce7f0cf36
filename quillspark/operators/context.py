"""Evidence selection: constraints, budgets and excerpts over ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import times


def omission(constraints: dict, relations: Column | None = None) -> Column:
    """The first constraint that a page fails, in a fixed order, or null.

    Columns: type, status, tags, source, confidence, tier, valid_from, valid_until, observed_at, occurred_at; and for a
    relationship (relation, target) an array of structs (relation, to_uri, raw)."""
    c, rules = constraints, []
    if c.get("type"):
        rules.append((~F.col("type").eqNullSafe(F.lit(c["type"])), "type"))
    if c.get("status"):
        rules.append((~F.col("status").eqNullSafe(F.lit(c["status"])), "status"))
    if c.get("tags"):
        rules.append((F.size(F.array_except(F.array(*[F.lit(t.strip()) for t in c["tags"]]), F.coalesce("tags", F.array().cast("array<string>")))) > 0, "tag"))
    if c.get("source"):
        rules.append((~F.col("source").eqNullSafe(F.lit(c["source"])), "source"))
    if c.get("min_confidence") is not None:
        rules.append((F.col("confidence").isNull() | (F.col("confidence") < c["min_confidence"]), "confidence"))
    if c.get("tier"):
        rules.append((~F.col("tier").eqNullSafe(F.lit(c["tier"])), "tier"))
    if c.get("as_of"):
        holds = times.applicability(times.instant(F.lit(c["as_of"])), *[F.col(x) for x in ("valid_from", "valid_until", "observed_at", "occurred_at")])
        rules += [(holds.isNull(), "time_undetermined"), (~holds, "time")]
    if c.get("relationship"):
        relation, target = c["relationship"]
        rules.append((~F.coalesce(F.exists(relations, lambda e: (e["relation"] == relation) & ((e["to_uri"] == target) | (e["raw"] == target))), F.lit(False)), "relationship"))
    out = None
    for failed, name in rules:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return F.lit(None).cast("string") if out is None else out


def budget(candidates: DataFrame, most_items: int, most_chars: int) -> DataFrame:
    """Candidates (position, content) in order, with accepted, kept_chars and reason.

    Taken while fewer than ``most_items`` are and characters remain; the last one may be cut. Candidates are a bounded
    list (a top-k), so the one window over them is small."""
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("content").cast("long")
    placed = candidates.withColumns({"rank": F.row_number().over(Window.orderBy("position")), "used": F.coalesce(F.sum(length).over(before), F.lit(0))})
    # once a candidate is refused, so are all later ones: both limits only fill up
    taken = (F.col("rank") <= most_items) & (F.col("used") < most_chars)
    refused_before = F.coalesce(F.sum(taken.cast("long")).over(before), F.lit(0))
    return placed.withColumns(
        {
            "accepted": taken,
            "kept_chars": F.when(taken, F.least(length, F.lit(most_chars) - F.col("used"))),
            "reason": F.when(~taken, F.when(refused_before >= most_items, "evidence_limit").otherwise("character_limit")),
        }
    ).drop("rank", "used")


def excerpts(sections: DataFrame, question: str, limit: int) -> DataFrame:
    """(uri, section, content, truncated): of each page's sections (uri, place, section, content) the one with most
    occurrences of the question's terms, the first of equals; place 0 is the whole body, which stays if none has any."""
    terms = T.question_terms(question)
    lower = F.lower(F.col("content"))
    hits = sum((T.occurrences(lower, F.lit(t)) for t in terms), F.lit(0).cast("long"))
    scored = sections.withColumn("hits", F.when(F.col("place") == 0, 0).otherwise(hits))
    best = scored.groupBy("uri").agg(F.max_by(F.struct("section", "content"), F.struct("hits", -F.col("place"))).alias("x"))
    return best.select("uri", "x.section", F.substring("x.content", 1, limit).alias("content"), (F.length("x.content") > limit).alias("truncated"))


STRATEGIES = {"lexical": (1.0, 0.0), "vector": (1.0, 100.0), "hybrid": (1.0, 1.0)}


def resolve(pages: DataFrame, trust: DataFrame, question: str, strategy: str = "lexical", vector: DataFrame | None = None, constraints: dict | None = None, most_items: int = 5, most_chars: int = 6000, edges: DataFrame | None = None, depth: int = 2, pool: int = 100, index: Index | None = None) -> dict:
    """Evidence for a question: excerpts of the pages taken, why others were left out, paths from the first to the others.

    ``pages``: (uri, title, path, type, tags, body, sections); ``trust``: what ``omission`` reads; ``vector``: (uri, position)
    of a vector search; ``index``: a stored index of the pages, which are read themselves without one. Candidates are a pool of at most ``pool`` from each list, fused by reciprocal ranks; a candidate
    that is no page any more is stale. Everything up to the final rows is one plan over that bounded pool."""
    from quillspark.operators import graph, lexical

    by_rank = Window.orderBy(F.desc("class"), F.desc("score"), "uri")
    hits, taken_hits = lexical.best(index, question, pool) if index is not None else lexical.ranked(pages, question), pool
    if T.question_class(question)[0] == "direct" and "description" in pages.columns:
        # an exact hit that says what it is answers a direct question alone
        first = lexical.top(hits, 1).join(pages.select("uri", "description"), "uri").first()
        taken_hits = 1 if first and first["class"] == 3 and (first["description"] or "").strip() else pool
    lists = {"lexical": (lexical.top(hits, taken_hits).withColumn("position", F.row_number().over(by_rank)), STRATEGIES[strategy][0])}
    if vector is not None and STRATEGIES[strategy][1]:
        lists["vector"] = (vector.orderBy("position").limit(pool), STRATEGIES[strategy][1])
    fused = lexical.fused(lists)
    ranked = fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("fused"), "uri")))
    has_edges = edges is not None and (constraints or {}).get("relationship")
    facts = trust
    if has_edges:
        own = edges.groupBy(F.col("from_uri").alias("uri")).agg(F.collect_list(F.struct("relation", "to_uri", "raw")).alias("edges"))
        facts = trust.join(own, "uri", "left")
    reason = omission(constraints or {}, F.col("edges") if has_edges else None)
    live = pages.select("uri", "body", "sections", F.lit(True).alias("known"))
    met = ranked.join(live, "uri", "left").join(facts, "uri", "left")
    judged = met.withColumn("reason", F.when(F.col("known").isNull(), "stale_candidate").otherwise(reason)).persist()
    try:
        fine = judged.where("reason IS NULL").select("uri", "position", "body", "sections")
        whole = fine.select("uri", F.lit(0).alias("place"), F.lit("").alias("section"), F.col("body").alias("content"))
        parts = fine.select("uri", F.posexplode("sections").alias("p", "s")).select("uri", (F.col("p") + 1).alias("place"), F.col("s.section").alias("section"), F.col("s.content").alias("content"))
        chosen = excerpts(whole.unionByName(parts), question, most_chars).join(fine.select("uri", "position"), "uri")
        rows = budget(chosen, most_items, most_chars).orderBy("position").collect()
        left_out = [(r["uri"], r["reason"]) for r in judged.where("reason IS NOT NULL").orderBy("position").select("uri", "reason").collect()]
    finally:
        judged.unpersist()
    taken = [{"uri": r["uri"], "section": r["section"], "content": r["content"][: r["kept_chars"]], "truncated": r["truncated"] or r["kept_chars"] < len(r["content"])} for r in rows if r["accepted"]]
    left_out += [(r["uri"], r["reason"]) for r in rows if not r["accepted"]]
    paths, gaps = {}, [] if taken else ["no evidence"]
    if edges is not None and len(taken) > 1:
        # one search from the first page finds the paths to all others
        others = [t["uri"] for t in taken[1:]]
        found = graph.paths_from(graph.directed(edges, "both"), taken[0]["uri"], depth, others)
        paths = {r["node"]: list(r["path"]) for r in found.where(F.col("node").isin(*others)).collect()}
        gaps += [f"no path to {u}" for u in others if u not in paths]
    return {"evidence": taken, "omissions": left_out[:pool], "paths": paths, "gaps": gaps}
