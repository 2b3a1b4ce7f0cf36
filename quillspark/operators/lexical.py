"""Field-weighted lexical ranking (BM25F) over pages: postings, statistics, scores, top hits, fused ranks.

``scores`` and ``ranked`` answer from the pages themselves, for corpora that are read once. ``build`` stores an inverted
index, from which ``best`` answers a question by reading its terms only. The index is three tables in one folder:

* ``postings``, partitioned by a hash of (scope, term), sorted by term and segment: a row is a block, the pages of one segment
  that have the term, each with its weighted frequency, and beside them their number and the largest frequency. A segment
  is a fixed part of all pages, about ``SEGMENT`` of them, the same for all terms, so that the largest frequencies bound what
  any page of a segment can score. However common a term is, no block holds more pages than its segment.
* ``names``, partitioned by a hash of the key: canonical names and tags whole, and the grams of names with their places,
  which tell exactly where a phrase occurs inside a name.
* ``stats``: pages, tokens and mean lengths by scope. Scopes (one user's memories, say) are corpora of their own in one index."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph

# How much a term in each field weighs.
WEIGHTS = {"title": 5.0, "aliases": 5.0, "tags": 3.0, "description": 2.0, "path": 2.0, "type": 1.0, "body": 1.0}
FIELDS = tuple(WEIGHTS)
K1, B = 1.2, 0.75


def _field(name: str) -> Column:
    return F.array_join(F.col(name), " ") if name in ("aliases", "tags") else F.col(name)


def field_tokens(pages: DataFrame) -> DataFrame:
    """(uri, field, tokens) for each page and field."""
    fields = [F.struct(F.lit(f).alias("field"), T.tokens(_field(f)).alias("tokens")) for f in FIELDS if f in pages.columns]
    return pages.select("uri", F.inline(F.array(*fields)))


def postings(pages: DataFrame) -> DataFrame:
    """(uri, field, term, tf): counted map-side before the shuffle."""
    return field_tokens(pages).select("uri", "field", F.explode("tokens").alias("term")).groupBy("uri", "field", "term").agg(F.count("*").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df): distinct pages across all fields."""
    return posted.select("uri", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def field_lengths(pages: DataFrame) -> DataFrame:
    return field_tokens(pages).select("uri", "field", F.size("tokens").alias("len"))


def field_means(lengths: DataFrame) -> DataFrame:
    """(field, n, total, mean): over all pages, empty fields too; 1 where a field has no tokens at all."""
    sums = lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    return sums.withColumn("mean", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total") / F.col("n")))


def _asked(pages: DataFrame, question: str) -> list[str]:
    return pages.sparkSession.range(1).select(T.query_tokens(F.lit(question)).alias("q")).first()["q"]


def _counted(pages: DataFrame, asked: list[str], *more: Column) -> DataFrame:
    """(uri, ..., len_<field>, tf_<field>): a few numbers a page, written once, so that the texts are read and their tokens
    counted only once however often statistics and scores are taken from it."""
    fields = [f for f in FIELDS if f in pages.columns]
    # a generator of one row keeps later projections from being merged into this one and repeating its work
    row = F.struct(*[T.token_counts(_field(f), asked).alias(f) for f in fields])
    counted = pages.select("uri", *more, F.inline(F.array(row)))
    names = [c for c in counted.columns if c not in fields]
    return graph.written(counted.select(*names, *[F.col(f"{f}.len").alias(f"len_{f}") for f in fields], *[F.col(f"{f}.tf").alias(f"tf_{f}") for f in fields]))


def _scored(counted: DataFrame, asked: list[str]) -> DataFrame:
    """``counted`` with score. Terms and fields are added up in a fixed order, so sums are the same on every run."""
    fields = [c.removeprefix("len_") for c in counted.columns if c.startswith("len_")]
    sums = counted.agg(
        F.count("*").alias("n"),
        *[F.sum(f"len_{f}").alias(f"total_{f}") for f in fields],
        *[F.sum((F.greatest(*[F.col(f"tf_{f}")[i] for f in fields], F.lit(0)) > 0).cast("long")).alias(f"df_{i}") for i in range(len(asked))],
    ).first()
    n = sums["n"] or 0
    total = F.lit(0.0)
    for i in range(len(asked)):
        weighted = F.lit(0.0)
        for f in fields:
            mean = sums[f"total_{f}"] / n if n and sums[f"total_{f}"] else 1.0
            normal = F.lit(1.0 - B) + F.lit(B) * F.col(f"len_{f}") / F.lit(mean)
            weighted = weighted + F.when(F.col(f"tf_{f}")[i] > 0, F.lit(WEIGHTS[f]) * F.col(f"tf_{f}")[i] / normal).otherwise(0.0)
        df = sums[f"df_{i}"] or 0
        idf = F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5)))
        total = total + F.when(weighted > 0, idf * (F.lit(K1 + 1) * weighted) / (F.lit(K1) + weighted)).otherwise(0.0)
    return counted.withColumn("score", total)


def scores(pages: DataFrame, question: str) -> DataFrame:
    """(uri, score) of the pages that share a term with the question; nothing is shuffled but the statistics."""
    asked = _asked(pages, question)
    if not asked:
        return pages.sparkSession.createDataFrame([], "uri string, score double")
    return _scored(_counted(pages, asked), asked).select("uri", "score").where("score > 0")


def ranked(pages: DataFrame, question: str) -> DataFrame:
    """(uri, class, score) of all hits, unordered."""
    empty = F.array().cast("array<string>")
    column = lambda c: F.col(c) if c in pages.columns else empty
    asked = _asked(pages, question)
    kind = T.match_class(F.lit(question), F.col("title"), column("aliases"), F.col("path"), column("tags")).alias("class")
    found = _scored(_counted(pages, asked, kind), asked)
    return found.select("uri", "class", "score").where((F.col("class") > 0) | (F.col("score") > 0))


SEGMENT, BUCKETS, GRAM = 1024, 64, 3
#: Segments that set the bar which others must reach, and segments that are named in a scan's filter and not joined.
FIRST, NAMED = 64, 1000


@dataclass
class Index:
    """A stored index; ``segments`` is the number of parts that the pages are in."""

    spark: SparkSession
    folder: str
    segments: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _names(pages: DataFrame) -> DataFrame:
    """(scope, uri, key, class, name, place, length): whole names ("=name": 3, a tag's 1), and grams of names with places (2)."""
    nothing = F.array().cast("array<string>")
    aliases, tags = (F.col(c) if c in pages.columns else nothing for c in ("aliases", "tags"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    made = pages.select(
        "scope",
        "uri",
        F.transform(F.concat(F.array("title"), F.coalesce(aliases, nothing), F.array("path")), T.canonical).alias("inside"),
        F.transform(F.array(stem, F.substring_index(stem, "/", -1)), T.canonical).alias("whole"),
        F.transform(F.coalesce(tags, nothing), T.canonical).alias("tags"),
    )

    def keys(names: Column, kind: int) -> Column:
        whole = F.array_distinct(F.filter(names, lambda n: n != ""))
        return F.transform(whole, lambda n: F.struct(F.concat(F.lit("="), n).alias("key"), F.lit(kind).alias("class"), F.lit(0).alias("name"), F.lit(0).alias("place")))

    def grams(width: int) -> Column:
        """Every gram of the names; short ones (for phrases shorter than GRAM) once a name."""

        def of(name: Column, k: Column) -> Column:
            places = F.when(F.length(name) >= width, F.sequence(F.lit(1), F.length(name) - (width - 1))).otherwise(F.array().cast("array<int>"))
            cut = F.transform(places, lambda i: F.struct(F.substring(name, i, F.lit(width)).alias("key"), F.lit(2).alias("class"), k.alias("name"), (i if width == GRAM else F.lit(1)).alias("place")))
            return cut if width == GRAM else F.array_distinct(cut)

        return F.flatten(F.transform("inside", of))

    rows = F.concat(keys(F.concat("inside", "whole"), 3), keys(F.col("tags"), 1), *[grams(w) for w in range(1, GRAM + 1)])
    return made.select("scope", "uri", F.inline(rows))


def _bucketed(frame: DataFrame, *by: str, spread: Column) -> DataFrame:
    """Dealt out by bucket, large buckets to several tasks, so that each bucket is in a few files, sorted by its keys."""
    told = frame.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    return told.repartition(F.col("bucket"), spread).sortWithinPartitions("bucket", *by)


def build(pages: DataFrame, scope: Column | None = None, folder: str | None = None) -> Index:
    """The stored index of pages (uri, title, path, type, body and, if there are any, aliases, tags, description).

    Texts are cut into tokens once; of their terms a row a page and term is stored and grouped into blocks. A term that all
    pages have is grouped by segment, so it is in no single task. A null or empty field has no tokens; an empty corpus has an
    empty index, which answers every question with nothing."""
    spark = pages.sparkSession
    folder = folder or f"{graph.shared(spark)}/lexical-{uuid.uuid4().hex}"
    pages = pages.withColumn("scope", F.lit("") if scope is None else scope)
    fields = [f for f in FIELDS if f in pages.columns]
    made = pages.select("scope", "uri", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(_field(f)).alias("tokens")) for f in fields])))
    terms = made.select("scope", "uri", "field", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    counts = [F.count(F.when(F.col("field") == f, 1)).alias(f"tf_{f}") for f in fields]
    lengths = [F.max(F.when(F.col("field") == f, F.col("len"))).alias(f"len_{f}") for f in fields]
    counted = graph.written(terms.groupBy("scope", "uri", "term").agg(*counts, *lengths))

    totals = counted.groupBy("scope").agg(*[F.sum(f"tf_{f}").alias(f"total_{f}") for f in fields])
    stats = pages.groupBy("scope").agg(F.count("*").alias("n")).join(totals, "scope", "left")
    means = {f"mean_{f}": F.when(F.col(f"total_{f}") > 0, F.col(f"total_{f}") / F.col("n")).otherwise(1.0) for f in fields}
    stats.withColumns(means).write.parquet(f"{folder}/stats")
    stats = spark.read.parquet(f"{folder}/stats")
    segments = -(-(stats.agg(F.sum("n")).first()[0] or 0) // SEGMENT) or 1

    weight = F.lit(0.0)
    for f in fields:
        normal = F.lit(1.0 - B) + F.lit(B) * F.col(f"len_{f}") / F.col(f"mean_{f}")
        weight = weight + F.when(F.col(f"tf_{f}") > 0, F.lit(WEIGHTS[f]) * F.col(f"tf_{f}") / normal).otherwise(0.0)
    weighed = counted.join(stats, "scope").select("scope", "term", "uri", weight.alias("w"), F.pmod(F.xxhash64("uri"), F.lit(segments)).cast("int").alias("segment"))
    blocks = weighed.groupBy("scope", "term", "segment").agg(F.count("*").alias("n"), F.max("w").alias("best"), F.array_sort(F.collect_list(F.struct("uri", "w"))).alias("hits"))
    dealt = _bucketed(blocks, "scope", "term", spread=F.floor(F.col("segment") / SEGMENT)).sortWithinPartitions("bucket", "scope", "term", "segment")
    dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
    graph.removed(counted)
    names = _bucketed(_names(pages), "scope", "key", spread=F.pmod(F.xxhash64("uri"), F.lit(-(-segments // SEGMENT))))
    names.write.partitionBy("bucket").parquet(f"{folder}/names")
    return Index(spark, folder, segments)


def _keyed(index: Index, table: str, column: str, scope: str, keys: list[str]) -> DataFrame:
    """The rows of some keys: only their buckets are read, and of those only the row groups that may have the keys."""
    made = F.array(*[F.pmod(F.xxhash64(F.lit(scope), F.lit(k)), F.lit(BUCKETS)).cast("int") for k in keys])
    buckets = sorted(set(index.spark.range(1).select(made.alias("b")).first()["b"]))
    return index.table(table).where(F.col("bucket").isin(buckets) & (F.col("scope") == scope) & F.col(column).isin(keys))


def classes(index: Index, question: str, scope: str = "") -> DataFrame | None:
    """(uri, class) of the pages whose names or tags match the question, as ``match_class`` says; null where none can."""
    q = index.spark.range(1).select(T.canonical(F.lit(question)).alias("q")).first()["q"]
    if not q:
        return None
    width = min(len(q), GRAM)
    offsets = sorted({*range(0, len(q) - width + 1, width), len(q) - width})
    rows = _keyed(index, "names", "key", scope, [f"={q}", *{q[o : o + width] for o in offsets}])
    exact = rows.where(F.col("key") == f"={q}").select("uri", "class")
    # a phrase is where all its grams are at their places; equal grams at several offsets count once an offset
    begins = F.explode(F.array(*[F.when(F.col("key") == q[o : o + width], F.col("place") - o) for o in offsets]))
    met = rows.where("class = 2").select("uri", "name", begins.alias("begin")).where("begin IS NOT NULL")
    inside = met.groupBy("uri", "name", "begin").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).select("uri", F.lit(2).alias("class"))
    return exact.unionByName(inside).groupBy("uri").agg(F.max("class").alias("class"))


def _summed(asked: list[str], idf: dict[str, float], frequency: list[Column]) -> Column:
    total = F.lit(0.0)
    for term, w in zip(asked, frequency, strict=True):
        if term in idf:
            total = total + F.when(w > 0, F.lit(idf[term]) * (F.lit(K1 + 1) * w) / (F.lit(K1) + w)).otherwise(0.0)
    return total


def best(index: Index, question: str, limit: int, scope: str = "", by_class: bool = True) -> DataFrame:
    """(uri, class, score) of the best pages, as ``top(ranked(...))`` gives, read from the stored index.

    The blocks' largest frequencies bound each segment's scores. Segments of the highest bounds are scored first; the
    score of place ``limit`` among them is the bar, and of the others only those are read whose bound reaches it (and those
    of pages whose names match). Without ``by_class`` names do not count."""
    spark = index.spark
    nothing = spark.createDataFrame([], "uri string, class int, score double")
    asked = spark.range(1).select(T.query_tokens(F.lit(question)).alias("q")).first()["q"]
    n = index.table("stats").where(F.col("scope") == scope).agg(F.max("n")).first()[0]
    if not asked or not n or limit < 1:
        return nothing
    named = classes(index, question, scope) if by_class else None
    blocks = _keyed(index, "postings", "term", scope, asked)
    heads = graph.written(blocks.select("term", "segment", "n", "best"))
    found = {r["term"]: r["df"] for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    logs = spark.range(1).select(*[F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5))) for df in found.values()]).first() if found else ()
    idf = dict(zip(found, logs, strict=True))

    def scored(rows: DataFrame) -> DataFrame:
        held = rows.select("term", F.inline("hits")).groupBy("uri").agg(*[F.max(F.when(F.col("term") == t, F.col("w"))).alias(f"w_{i}") for i, t in enumerate(asked)])
        return held.select("uri", _summed(asked, idf, [F.col(f"w_{i}") for i in range(len(asked))]).alias("score"))

    bests = heads.groupBy("segment").agg(*[F.max(F.when(F.col("term") == t, F.col("best"))).alias(f"w_{i}") for i, t in enumerate(asked)])
    # a little room, as rounding is not monotone
    bounds = bests.select("segment", (_summed(asked, idf, [F.col(f"w_{i}") for i in range(len(asked))]) * (1 + 1e-9)).alias("bound"))
    first = [r["segment"] for r in bounds.orderBy(F.desc("bound"), "segment").limit(FIRST).collect()]
    held = scored(blocks.where(F.col("segment").isin(first))).orderBy(F.desc("score"), "uri").limit(limit).collect()
    bar = held[-1]["score"] if len(held) == limit else 0.0
    wanted = bounds.where(F.col("bound") >= bar).select("segment")
    if named is not None:
        named = graph.written(named)
        wanted = wanted.unionByName(named.select(F.pmod(F.xxhash64("uri"), F.lit(index.segments)).cast("int").alias("segment")))
    wanted = wanted.distinct()
    some = [r["segment"] for r in wanted.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        chosen = blocks.where(F.col("segment").isin(some))
        graph.removed(heads)
    else:
        chosen = blocks.join(wanted, "segment", "left_semi")
    hits = scored(chosen)
    if named is None:
        hits = hits.withColumn("class", F.lit(0))
    else:
        hits = hits.join(named, "uri", "full")
    hits = hits.select("uri", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return top(hits.where((F.col("class") > 0) | (F.col("score") > 0)), limit)


def top(hits: DataFrame, limit: int) -> DataFrame:
    """The best hits: match class, then unrounded score, then uri."""
    return hits.orderBy(F.desc("class"), F.desc("score"), "uri").limit(limit)


def search(pages: DataFrame | Index, question: str, limit: int = 3, scope: str = "") -> DataFrame:
    """(uri, class, score): the best pages, with rounded scores; from a stored index, or from the pages themselves."""
    hits = best(pages, question, limit, scope) if isinstance(pages, Index) else top(ranked(pages, question), limit)
    return hits.withColumn("score", T.rounded(F.col("score")))


def path_candidates(pages: DataFrame | Index, ends: tuple[str, str], limit: int) -> DataFrame:
    """The best page of each end, then the best for both together, each page once."""
    lists = [(0, ends[0], 1), (1, ends[1], 1), (2, f"{ends[0]} {ends[1]}", limit)]
    parts = [search(pages, q, n).withColumn("list", F.lit(i)) for i, q, n in lists]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    placed = both.withColumn("place", F.row_number().over(Window.orderBy("list", F.desc("class"), F.desc("score"), "uri")))
    once = placed.withColumn("again", F.row_number().over(Window.partitionBy("uri").orderBy("place"))).where("again = 1")
    return once.orderBy("place").limit(limit).select("uri", "class", "score", "place")


def fused(lists: dict[str, tuple[DataFrame, float]], constant: int = 60) -> DataFrame:
    """(uri, fused): reciprocal-rank fusion of lists (uri, position) with weights."""
    parts = None
    for frame, weight in lists.values():
        own = frame.select("uri", (F.lit(float(weight)) / (constant + F.col("position"))).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("uri").agg(F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda s, x: s + x).alias("fused"))


def should_read(path: list[str], candidates: list[str], most: int) -> list[str]:
    """The path's pages, then the candidates', each once."""
    return list(dict.fromkeys([*path, *candidates]))[:most]


def query(pages: DataFrame, question: str, limit: int = 3, most_read: int = 3, edges: DataFrame | None = None, depth: int = 3, index: Index | None = None) -> dict:
    """A whole lexical answer: its kind, candidates, path, what to read, and whether the index alone answers it.

    Without an ``index`` of the pages one is built for the question where it takes several searches."""
    kind, ends = T.question_class(question)
    source = index or (build(pages) if kind == "path" else pages)
    found = path_candidates(source, ends, limit) if kind == "path" else search(source, question, limit)
    described = pages.select("uri", "title", "type", T.cut(F.col("description"), 200).alias("description"))
    order = ["place"] if "place" in found.columns else [F.desc("class"), F.desc("score"), "uri"]
    rows = [r.asDict() for r in found.join(described, "uri").orderBy(*order).collect()]
    path: list[str] = []
    if kind == "path" and edges is not None:
        first, last = (search(source, e, 1).first() for e in ends)
        if first and last:
            path = graph.shortest_path(graph.undirected(edges), first["uri"], last["uri"], depth)["nodes"]
    if not rows:
        return {"kind": kind, "candidates": [], "path": path, "should_read": [], "index_only": True}
    if kind == "direct" and rows[0]["class"] == 3 and (rows[0]["description"] or "").strip():
        return {"kind": kind, "candidates": rows[:1], "path": path, "should_read": [], "index_only": True}
    return {"kind": kind, "candidates": rows, "path": path, "should_read": should_read(path, [r["uri"] for r in rows], most_read), "index_only": False}
