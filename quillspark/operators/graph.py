"""Typed directed graphs as edge tables (from_uri, to_uri, relation, raw).

Searches walk an edge table as it is, or ``stored`` arcs: each edge under both its ends, partitioned by a hash of the node
and sorted by it, so that a hop reads the buckets of its frontier only. A hop takes the frontier's arcs before anything is
made distinct; what is kept of a level is a row a node with its predecessor, not whole paths."""

from __future__ import annotations

import uuid
import weakref
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared").rstrip("/")


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the folder that all executors share; cuts lineage, and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared(spark)}/graph-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out), path)
    return out


_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def removed(*frames: DataFrame) -> None:
    """Removes the files of tables made by ``written`` that nothing reads any more."""
    for frame in frames:
        known, path = _WRITTEN.pop(id(frame), (lambda: None, ""))
        if known() is frame:
            spark = frame.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def build_edges(explicit: DataFrame, links: DataFrame) -> DataFrame:
    """Explicit edges, and a ``links_to`` edge for each link whose target has none; without loops, each relation once.

    Both have (from_uri, to_uri, raw, ord); explicit ones also a relation. Of equal edges the first authored stays."""
    untyped = links.join(explicit.select("from_uri", "to_uri").distinct(), ["from_uri", "to_uri"], "left_anti").withColumn("relation", F.lit("links_to"))
    both = explicit.withColumn("source", F.lit("explicit")).unionByName(untyped.withColumn("source", F.lit("body"))).where("from_uri <> to_uri")
    first = Window.partitionBy("from_uri", "to_uri", "relation").orderBy("source", "ord", "raw")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "ord")


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node."""
    return edges.join(nodes.select(F.col("uri").alias("to_uri")), "to_uri", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("uri").alias("to_uri")), "to_uri", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    flat = edges.select("from_uri", "to_uri")
    return flat.unionByName(flat.select(F.col("to_uri").alias("from_uri"), F.col("from_uri").alias("to_uri"))).distinct()


def directed(edges: DataFrame, direction: str, relations: tuple[str, ...] = ()) -> DataFrame:
    """Edges as they may be walked: out, in or both; relations restrict them before anything is joined."""
    kept = edges.where(F.col("relation").isin(*relations)) if relations else edges
    out = kept.select("from_uri", "to_uri", "relation")
    back = kept.select(F.col("to_uri").alias("from_uri"), F.col("from_uri").alias("to_uri"), "relation")
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def neighbours(edges: DataFrame, uri: str, direction: str = "both", relations: tuple[str, ...] = ()) -> DataFrame:
    """Edges that touch a node, once each, in order. Two filters, no join."""
    kept = edges.where(F.col("relation").isin(*relations)) if relations else edges
    sides = {"out": F.col("from_uri") == uri, "in": F.col("to_uri") == uri}
    touched = kept.where(sides[direction] if direction in sides else sides["out"] | sides["in"])
    first = Window.partitionBy("from_uri", "to_uri", "relation").orderBy("raw")
    return touched.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("from_uri", "to_uri", "relation")


def bounded(frame: DataFrame, order: list, limit: int) -> DataFrame:
    """At most ``limit`` rows in order, each with the total and whether rows were left out."""
    total = frame.agg(F.count("*").alias("total"))
    return frame.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


#: Partitions of stored arcs, frontiers whose nodes are named in the scan's filter, arcs of a bucket's file, and frontiers that
#: one task puts in order; and frontiers whose hashes all tasks get, so that only arcs that leave them are shuffled.
BUCKETS, NAMED, FILE, SORTED, HASHED = 64, 1000, 1 << 20, 100_000, 2_000_000


@dataclass
class Walk:
    """Stored arcs and how they are walked: out, in or both, and by which relations."""

    spark: SparkSession
    folder: str
    direction: str = "out"
    relations: tuple[str, ...] = ()

    def along(self, direction: str, relations: tuple[str, ...] = ()) -> Walk:
        if direction not in ("out", "in", "both"):
            raise ValueError(f"unknown direction {direction!r}")
        return Walk(self.spark, self.folder, direction, relations)

    def rows(self, names: list[str] | None, back: bool) -> DataFrame:
        """(node, other, relation) of some nodes, or of all."""
        found = self.spark.read.parquet(self.folder)
        if names is not None:
            made = F.array(*[F.pmod(F.xxhash64(F.lit(n)), F.lit(BUCKETS)).cast("int") for n in names])
            buckets = sorted(set(self.spark.range(1).select(made.alias("b")).first()["b"])) if names else []
            found = found.where(F.col("bucket").isin(buckets) & F.col("node").isin(names))
        if self.direction != "both":
            found = found.where(F.col("side") == ("in" if back != (self.direction == "in") else "out"))
        if self.relations:
            found = found.where(F.col("relation").isin(*self.relations))
        return found.select("node", "other", "relation")


def stored(edges: DataFrame) -> Walk:
    """Arcs of an edge table (from_uri, to_uri, relation), stored once for any number of searches. A node with very many
    edges is in several files of its bucket."""
    spark = edges.sparkSession
    folder = f"{shared(spark)}/arcs-{uuid.uuid4().hex}"
    end = lambda node, other, side: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.col("relation"), F.lit(side).alias("side"))
    arcs = edges.select(F.inline(F.array(end("from_uri", "to_uri", "out"), end("to_uri", "from_uri", "in")))).withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int"))
    files = -(-2 * edges.count() // (FILE * BUCKETS)) or 1
    dealt = arcs.repartition("bucket", F.pmod(F.xxhash64("other"), F.lit(files))).sortWithinPartitions("bucket", "node", "other")
    dealt.write.partitionBy("bucket").parquet(folder)
    return Walk(spark, folder)


def _hop(arcs: DataFrame | Walk, near: DataFrame | list[str] | None, back: bool = False) -> DataFrame:
    """(node, other, relation) of the arcs from ``near`` (nodes by name, a frame with node, or null for all nodes), against their
    direction if ``back``."""
    names = near if isinstance(near, list) else None
    if isinstance(arcs, Walk):
        found = arcs.rows(names, back)
    else:
        a, b = ("to_uri", "from_uri") if back else ("from_uri", "to_uri")
        found = arcs.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col("relation") if "relation" in arcs.columns else F.lit(None).cast("string").alias("relation"))
        found = found if names is None else found.where(F.col("node").isin(names))
    return found.join(near, "node") if isinstance(near, DataFrame) else found


def _named(level: DataFrame, n: int) -> DataFrame | list[str]:
    """A level's nodes by name, where they are few."""
    return [r["node"] for r in level.select("node").collect()] if n <= NAMED else level.select("node")


def _left(arcs: DataFrame | Walk, level: DataFrame, n: int) -> DataFrame:
    """(node, other, relation, place) of the arcs from a level of ``n`` nodes. Arcs of a frontier that is not large are told by
    its nodes' hashes before they are shuffled, so a hop over an edge table shuffles what leaves the frontier, not all edges."""
    near = level.select("node", "place")
    if n <= NAMED:
        return _hop(arcs, _named(level, n)).join(F.broadcast(near), "node")
    found = _hop(arcs, None)
    if n <= HASHED:
        told = near.select(F.xxhash64("node").alias("told")).distinct()
        found = found.join(F.broadcast(told), F.xxhash64("node") == F.col("told"), "left_semi")
    return found.join(near, "node")


def levels_from(arcs: DataFrame | Walk, source: str, depth: int, targets: list[str] | None = None, paths: bool = True) -> list[DataFrame]:
    """The levels of a search from ``source``, each (node, place, parent) in the shared folder: of the predecessors of a node
    the one with the least path by node names, and the node's place among its level's least paths.

    A level is a join of the frontier with the arcs and a minimum by node, so each node is kept once. The search ends
    when nothing new is found, or all targets are. Places are null at ``depth``, from where nothing goes on, and without
    ``paths``, where parents are too."""
    from quillspark.operators import ranks

    spark = arcs.spark if isinstance(arcs, Walk) else arcs.sparkSession
    levels, n, waiting = [spark.createDataFrame([(source, 0, None)], "node string, place long, parent string")], 1, set(targets or ()) - {source}
    seen = levels[0].select("node")
    while (depth < 0 or len(levels) <= depth) and (targets is None or waiting):
        met = _left(arcs, levels[-1], n)
        if paths:
            came = met.groupBy("other").agg(F.min(F.struct("place", F.col("node").alias("parent"))).alias("x")).select(F.col("other").alias("node"), F.col("x.place").alias("before"), "x.parent")
        else:
            came = met.select(F.col("other").alias("node"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["node"])
        new = came.join(seen, "node", "left_anti")
        if not paths or len(levels) == depth:
            level = written(new.select("node", F.lit(None).cast("long").alias("place"), "parent"))
            n = level.count()
        else:
            new = written(new)
            n = new.count()
            if n <= SORTED:
                placed = new.withColumn("place", (F.row_number().over(Window.orderBy("before", "node")) - 1).cast("long"))
            else:
                placed = ranks.ranked(new, [], ["before", "node"]).withColumnRenamed("rank", "place")
            level = written(placed.select("node", "place", "parent"))
            removed(new)
        if not n:
            removed(level)
            break
        if waiting:
            waiting -= {r["node"] for r in level.where(F.col("node").isin(*waiting)).select("node").collect()}
        levels.append(level)
        seen = seen.unionByName(level.select("node"))
    return levels


def reached(arcs: DataFrame | Walk, source: str, depth: int = -1) -> DataFrame:
    """(node, level) of all nodes within ``depth``."""
    out = None
    for k, level in enumerate(levels_from(arcs, source, depth, paths=False)):
        own = level.select("node", F.lit(k).alias("level"))
        out = own if out is None else out.unionByName(own)
    return out


def paths_from(arcs: DataFrame | Walk, source: str, depth: int, targets: list[str] | None = None) -> DataFrame:
    """(node, level, path): the shortest path to each node within ``depth`` (or to the targets, where they are given), of equal
    lengths the least by node names, put together from the levels' predecessors."""
    levels = levels_from(arcs, source, depth, targets)
    out = None
    for k, level in enumerate(levels):
        own = level if targets is None else level.where(F.col("node").isin(*targets))
        way = own.select("node", F.array("node").alias("path"), F.col("parent").alias("up"))
        for above in reversed(levels[:k]):
            up = above.select(F.col("node").alias("up"), F.col("parent").alias("next"))
            way = way.join(up, "up").select("node", F.concat(F.array("up"), "path").alias("path"), F.col("next").alias("up"))
        way = way.select("node", F.lit(k).alias("level"), "path")
        out = way if out is None else out.unionByName(way)
    return out


def _between(arcs: DataFrame | Walk, source: str, target: str, depth: int) -> list[str]:
    """The shortest path, of equal ones the least by node names; empty where there is none within ``depth``.

    Searched from both ends, the side with the smaller frontier first. Where levels meet, those nodes of the forward levels
    are kept that lead to the meeting; then the path is read off node by node, the least name at each step."""
    if source == target:
        return [source]
    spark = arcs.spark if isinstance(arcs, Walk) else arcs.sparkSession
    sides = {back: [spark.createDataFrame([(end,)], "node string")] for back, end in ((False, source), (True, target))}
    sizes = {False: 1, True: 1}
    while True:
        if 0 <= depth <= len(sides[False]) + len(sides[True]) - 2:
            return []
        back = sizes[True] < sizes[False]
        own = sides[back]
        seen = own[0]
        for level in own[1:]:
            seen = seen.unionByName(level)
        found = _hop(arcs, _named(own[-1], sizes[back]), back).select(F.col("other").alias("node")).distinct()
        new = written(found.join(seen, "node", "left_anti"))
        sizes[back] = new.count()
        if not sizes[back]:
            return []
        own.append(new)
        meeting = new.join(sides[not back][-1], "node")
        if not meeting.isEmpty():
            break
    forward, backward = sides[False], sides[True]
    leading = [written(meeting)]
    for level in reversed(forward[1:-1]):
        into = _hop(arcs, _named(leading[0], leading[0].count()), True).select(F.col("other").alias("node")).distinct()
        leading.insert(0, written(level.join(into, "node", "left_semi")))
    way = [source]
    for level in leading + backward[-2::-1] if len(forward) > 1 else backward[-2::-1]:
        step = _hop(arcs, [way[-1]]).select(F.col("other").alias("node")).join(level, "node", "left_semi")
        way.append(step.agg(F.min("node")).first()[0])
    removed(*leading, *forward[1:], *backward[1:])
    return way


def shortest_path(arcs: DataFrame | Walk, source: str, target: str, depth: int = -1) -> dict:
    """nodes and relations (the least of each hop) of the path; empty where there is none."""
    nodes = _between(arcs, source, target, depth)
    relations: list[str | None] = []
    if len(nodes) > 1 and (isinstance(arcs, Walk) or "relation" in arcs.columns):
        spark = arcs.spark if isinstance(arcs, Walk) else arcs.sparkSession
        hops = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False))], "hop int, node string, other string")
        relations = [r["relation"] for r in F.broadcast(hops).join(_hop(arcs, nodes[:-1]), ["node", "other"]).groupBy("hop").agg(F.min("relation").alias("relation")).orderBy("hop").collect()]
    return {"nodes": nodes, "relations": relations}


def path_status(edges: DataFrame | Walk, nodes: DataFrame, source: str, target: str, direction: str = "out", relations: tuple[str, ...] = (), depth: int = -1) -> dict:
    """The path, and found, unknown_source, unknown_target, disconnected or depth_exceeded."""
    known = {r["uri"] for r in nodes.where(F.col("uri").isin(source, target)).select("uri").collect()}
    if source not in known or target not in known:
        return {"status": "unknown_source" if source not in known else "unknown_target", "nodes": [], "relations": []}
    # one search from both ends: where there is no path, the smaller side is soon used up
    arcs = edges.along(direction, relations) if isinstance(edges, Walk) else directed(edges, direction, relations)
    found = shortest_path(arcs, source, target)
    if found["nodes"] and (depth < 0 or len(found["nodes"]) <= depth + 1):
        return {"status": "found", **found}
    return {"status": "depth_exceeded" if found["nodes"] else "disconnected", "nodes": [], "relations": []}


def ego(edges: DataFrame, uri: str, limit: int = 300) -> DataFrame:
    """(node, hops): the node, its neighbours and theirs, nearest first, at most ``limit``."""
    both = undirected(edges)
    one = both.where(F.col("from_uri") == uri).select(F.col("to_uri").alias("node"), F.lit(1).alias("hops"))
    two = one.join(both, F.col("node") == F.col("from_uri")).select(F.col("to_uri").alias("node"), F.lit(2).alias("hops"))
    zero = edges.sparkSession.createDataFrame([(uri, 0)], "node string, hops int")
    return zero.unionByName(one).unionByName(two).groupBy("node").agg(F.min("hops").alias("hops")).orderBy("hops", "node").limit(limit)


def supersession(pages: DataFrame, hops: int = 32) -> DataFrame:
    """(uri, status, last, chain) of pages with a successor: current, missing_target, cycle or depth_exceeded.

    ``pages``: (uri, next, authored); ``next`` is the successor's uri, null where what was authored resolves to nothing.
    Out-degree is one, so each hop is one join of those that are still on their way."""
    base = written(pages.select("uri", "next", "authored"))
    follow = base.select(F.col("uri").alias("f_uri"), F.col("next").alias("f_next"), F.col("authored").alias("f_authored"))
    moving = base.where("authored IS NOT NULL").select("uri", F.array("uri").alias("chain"), F.col("next"), F.col("authored"))
    done = None
    for hop in range(hops + 1):
        state = F.when(F.col("authored").isNull(), "current").when(F.col("next").isNull(), "missing_target").when(F.array_contains("chain", F.col("next")), "cycle")
        now = written(moving.withColumn("status", state))
        chain = F.when(F.col("status") == "cycle", F.concat("chain", F.array("next"))).otherwise(F.col("chain"))
        ended = now.where("status IS NOT NULL").select("uri", "status", chain.alias("chain"))
        done = ended if done is None else done.unionByName(ended)
        moving = now.where("status IS NULL")
        if moving.isEmpty():
            break
        if hop == hops:
            done = done.unionByName(moving.select("uri", F.lit("depth_exceeded").alias("status"), "chain"))
            break
        moving = moving.join(follow, F.col("next") == F.col("f_uri")).select("uri", F.concat("chain", F.array("next")).alias("chain"), F.col("f_next").alias("next"), F.col("f_authored").alias("authored"))
    return done.select("uri", "status", F.element_at("chain", -1).alias("last"), "chain")


def cycles(chains: DataFrame) -> DataFrame:
    """Distinct cycles among chains that end in one: their members, sorted, without the closing node."""
    return chains.where("status = 'cycle'").select(F.array_sort(F.slice("chain", 1, F.size("chain") - 1)).alias("members")).distinct()
