"""Code symbols and relations: resolution, neighbours, coverage, search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import graph, ranks

#: Symbols that one candidate set's row names, a name of more is several rows of the dictionary; candidates that a task lists,
#: relations to a name that list more are dealt out to several tasks; and as how many candidates a relation itself counts.
SET, LISTED, OWN = 1000, 30_000_000, 10
LEVELS = ("unsupported", "partial", "complete")


def names(symbols: DataFrame) -> DataFrame:
    """(name, symbol_id): a symbol's names, empty ones never."""
    named = symbols.select(F.col("id").alias("symbol_id"), F.explode(F.array("name", "qualified_name")).alias("name"))
    return named.where("name IS NOT NULL AND name <> ''").distinct()


def candidate_sets(symbols: DataFrame, most: int = SET) -> DataFrame:
    """(name, part, size, members): the dictionary of candidate sets, each name once, its symbols in order and in ranked parts
    of at most ``most``. A name that a third of all symbols have is many rows, made in many tasks."""
    return ranks.parts_of(names(symbols), ["name"], "symbol_id", most)


def whole_sets(symbols: DataFrame) -> DataFrame:
    """(name, size, members): each name once with all its symbols in order, put together from the parts of the dictionary."""
    parts = candidate_sets(symbols).groupBy("name").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("part", "members"))).alias("parts"))
    return parts.select("name", "size", F.flatten("parts.members").alias("members"))


def resolve(relations: DataFrame, symbols: DataFrame, sets: DataFrame | None = None, told: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Relations with candidates (ids of all symbols so named, in order), n_candidates and resolution: unresolved, resolved or
    ambiguous. With a dictionary of ``sets`` (``candidate_sets``) a row carries the first part of its name's set only; the others
    are in the dictionary under the relation's target. ``told`` is what a row says of its candidates, such as a text of them,
    and is made once a set.

    What comes out is as large as relations times candidates. Relations to one name come out one after the other, in as few
    tasks as list at most ``LISTED`` candidates each, so that a columnar file has one copy of a text for all of them."""
    own = relations.drop("candidates", "n_candidates", "resolution")
    whole = whole_sets(symbols) if sets is None else sets.where("part = 0").select("name", "size", "members")
    whole = graph.written(whole.select(F.col("name").alias("c_name"), F.col("size").alias("n_candidates"), F.size("members").alias("c_listed"), told(F.col("members")).alias("candidates")))
    listed = own.groupBy(F.col("target").alias("c_target")).agg(F.count("*").alias("n")).join(whole.select("c_name", "c_listed"), F.col("c_target") == F.col("c_name"), "left")
    listed = listed.select("c_target", (F.col("n") * (F.coalesce("c_listed", F.lit(0)) + OWN)).alias("n"))
    # a row with the names of more than a task's candidates, of which there are at most as many as tasks
    sums = graph.written(listed.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > LISTED, F.struct("c_target", F.ceil(F.col("n") / LISTED).cast("int").alias("c_tasks")))).alias("hot")))
    tasks = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sums.first()["n"] or 0) // LISTED))
    hot = F.broadcast(sums.select(F.inline("hot")))
    dealt = F.coalesce("c_tasks", F.lit(1))
    known = whole.join(hot, F.col("c_name") == F.col("c_target"), "left").withColumn("c_place", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("c_target", "c_tasks", "c_listed")
    placed = own.join(hot, F.col("target").eqNullSafe(F.col("c_target")), "left").withColumn("c_dealt", F.pmod(F.xxhash64("id"), dealt).cast("int")).drop("c_target", "c_tasks")
    # a merge keeps the relations in the order of their targets
    same = (F.col("target") == F.col("c_name")) & (F.col("c_dealt") == F.col("c_place"))
    met = placed.repartition(tasks, "target", "c_dealt").join(known.repartition(tasks, "c_name", "c_place").hint("merge"), same, "left").drop("c_name", "c_place", "c_dealt")
    met = met.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0).cast("long")), "candidates": F.coalesce("candidates", told(F.array().cast("array<string>")))})
    n = F.col("n_candidates")
    return met.withColumn("resolution", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous"))


@dataclass
class Adjacency:
    """Symbols and relations as two sides of a graph whose middle are keys: names, ids and documents.

    ``symbols`` (symbol_id, key, side) and ``relations`` (relation_id, key, side) say which keys a symbol answers to and
    which a relation names, as source (side out) and as target (in). A walk is two half steps over keys; the pairs of a
    document's symbols with its relations' targets are never made, so rows are linear in symbols and relations."""

    symbols: DataFrame
    relations: DataFrame

    def step(self, near: DataFrame, direction: str = "out") -> DataFrame:
        """(symbol_id, place, relation_id, came): what symbols ``near`` (at, place) lead to, each with the least (place, symbol
        it was reached from, relation)."""
        first, second = ("out", "in") if direction == "out" else ("in", "out")
        # half a step to the relations: of each key the least place, so a document's symbols meet its relations once
        keys = near.join(self.symbols.where(F.col("side") == first), F.col("at") == F.col("symbol_id")).groupBy("key").agg(F.min(F.struct("place", F.col("at").alias("came"))).alias("x"))
        met = self.relations.where(F.col("side") == first).join(keys, "key").groupBy("relation_id").agg(F.min("x").alias("x"))
        # and half a step to the symbols: of each key the least relation
        far = self.relations.where(F.col("side") == second).join(met, "relation_id").groupBy("key").agg(F.min(F.struct("x.place", "x.came", "relation_id")).alias("y"))
        found = self.symbols.where(F.col("side") == second).join(far, "key").groupBy("symbol_id").agg(F.min("y").alias("y"))
        return found.select("symbol_id", "y.place", "y.relation_id", "y.came")


def _keys(**kinds: Column) -> Column:
    told = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k[0]}:"), c)) for k, c in kinds.items()]
    return F.explode(F.array_distinct(F.array_compact(F.array(*told))))


def adjacency(relations: DataFrame, symbols: DataFrame) -> Adjacency:
    """A relation leads from the symbols that have its source as a name or are in its document, to those that have its target
    or a candidate as a name, or a candidate as id."""
    own = symbols.select(F.col("id").alias("symbol_id"), "name", "qualified_name", "document_id")
    answers = {"out": _keys(n=F.col("name"), nq=F.col("qualified_name"), d=F.col("document_id")), "in": _keys(n=F.col("name"), nq=F.col("qualified_name"), i=F.col("symbol_id"))}
    sides = [own.select("symbol_id", keys.alias("key"), F.lit(side).alias("side")) for side, keys in answers.items()]
    given = relations.select(F.col("id").alias("relation_id"), "source", "target", "document_id", (F.col("candidates") if "candidates" in relations.columns else F.lit(None).cast("array<string>")).alias("candidates"))
    out = given.select("relation_id", _keys(n=F.col("source"), d=F.col("document_id")).alias("key"), F.lit("out").alias("side"))
    named = F.concat(F.array("target"), F.coalesce("candidates", F.array().cast("array<string>")))
    targets = F.concat(F.transform(named, lambda c: F.concat(F.lit("n:"), c)), F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: F.concat(F.lit("i:"), c)))
    back = given.select("relation_id", F.explode(F.array_distinct(F.filter(targets, lambda k: k.isNotNull() & (F.length(k) > 2)))).alias("key"), F.lit("in").alias("side"))
    return Adjacency(sides[0].unionByName(sides[1]), out.unionByName(back))


def neighbours(adjacent: Adjacency, symbol: str, direction: str = "out") -> DataFrame:
    """(symbol_id, relation_id): neighbours of a symbol, each with its first relation, in order."""
    near = adjacent.symbols.sparkSession.createDataFrame([(0, symbol)], "place int, at string")
    return adjacent.step(F.broadcast(near), direction).where(F.col("symbol_id") != symbol).select("symbol_id", "relation_id").orderBy("symbol_id")


def coverage(documents: DataFrame) -> DataFrame:
    """(capability, level): the lowest level of any document (coverage: array of structs capability, level)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    lowest = documents.select(F.inline("coverage")).groupBy("capability").agg(F.min(rank).alias("r"))
    return lowest.select("capability", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("r").cast("int")).alias("level"))


def search(symbols: DataFrame, query: str, language: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols with the query in a name, in order, with the total before the limit."""
    q = query.lower()
    hit = symbols.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower(F.coalesce("qualified_name", F.lit(""))), F.lit(q)))
    if language:
        hit = hit.where(F.col("language") == language)
    return hit.orderBy("name", "id").limit(limit).crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))


def diagnostics(found: DataFrame, path: str | None = None, language: str | None = None, category: str | None = None) -> DataFrame:
    for name, want in (("path", path), ("language", language), ("category", category)):
        if want:
            found = found.where(F.col(name) == want)
    return found


def symbol(symbols: DataFrame, id_: str) -> DataFrame:
    """The symbol of an id; an unknown id is an error."""
    found = symbols.where(F.col("id") == id_)
    if found.isEmpty():
        raise KeyError(id_)
    return found


def span_is_valid(start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """Whether lines and columns count from one and the end is not before the start."""
    return (start_line >= 1) & (start_column >= 1) & ((end_line > start_line) | (end_line == start_line) & (end_column >= start_column))


def path_is_valid(path: Column) -> Column:
    """Whether a path is relative and stays inside its root."""
    outside = path.startswith("/") | path.startswith("../") | F.contains(path, F.lit("/../")) | F.contains(path, F.lit("\0"))
    return F.coalesce((path != "") & (path != ".") & ~outside, F.lit(False))


def first_relations(relations: DataFrame, symbol: dict, direction: str, limit: int) -> DataFrame:
    """Relations of one symbol: incoming by target name, outgoing by source name or document; at most ``limit``, in order, each
    with the total and whether some were left out."""
    own = [n for n in (symbol["name"], symbol.get("qualified_name")) if n]
    hit = F.col("target").isin(*own) if direction == "in" else F.col("source").isin(*own) | (F.col("document_id") == symbol["document_id"])
    return graph.bounded(relations.where(hit), ["id"], limit)


@dataclass
class Pairs:
    """Adjacency as (relation_id, from_id, to_id) rows, each a relation between two known symbols. A step is one join with the
    symbols to go on from; where these are broadcast, the rows are read and not shuffled."""

    relations: DataFrame

    def step(self, near: DataFrame, direction: str = "out") -> DataFrame:
        """As ``Adjacency.step``; of relations with one id the least pair comes first."""
        a, b = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
        met = self.relations.select(F.col(a).alias("at"), F.col(b).alias("symbol_id"), F.struct("relation_id", "from_id", "to_id").alias("relation_id")).where("symbol_id IS NOT NULL")
        least = F.min(F.struct("place", F.col("at").alias("came"), "relation_id")).alias("y")
        found = met.join(near, "at").groupBy("symbol_id").agg(least)
        return found.select("symbol_id", "y.place", "y.relation_id", "y.came")


def path(adjacent: Adjacency | DataFrame, source: str, target: str, direction: str = "out", depth: int = 1000, limit: int = 1000) -> dict:
    """symbols and relations of the first path that a breadth-first search finds, and whether it was cut off.

    ``adjacent``: an ``Adjacency``, or (relation_id, from_id, to_id) rows. At most ``limit`` symbols are visited, in order of
    their level, their predecessor's place and their id, and none is gone on from at ``depth`` relations. A level is a step
    from the symbols to go on from, at most ``limit``; so is what comes back."""
    adjacent = adjacent if isinstance(adjacent, Adjacency) else Pairs(adjacent)
    spark = adjacent.relations.sparkSession
    came: dict[str, tuple[str | None, str | None]] = {source: (None, None)}
    level, hops = [source], 0
    while level and target not in came and hops < depth and len(came) < limit:
        frontier = spark.createDataFrame(list(enumerate(level)), "place int, at string")
        known = spark.createDataFrame([(x,) for x in came], "known string")
        step = adjacent.step(F.broadcast(frontier), direction).join(F.broadcast(known), F.col("symbol_id") == F.col("known"), "left_anti")
        level = []
        for r in step.orderBy("place", "symbol_id").limit(limit - len(came)).collect():
            relation = r["relation_id"] if isinstance(r["relation_id"], str) else r["relation_id"]["relation_id"]
            came[r["symbol_id"]] = (r["came"], relation)
            level.append(r["symbol_id"])
        hops += 1
    if target not in came:
        return {"symbols": [], "relations": [], "truncated": len(came) >= limit}
    symbols, relations = [target], []
    while (up := came[symbols[0]])[0] is not None:
        symbols.insert(0, up[0])
        relations.insert(0, up[1])
    return {"symbols": symbols, "relations": relations, "truncated": False}
