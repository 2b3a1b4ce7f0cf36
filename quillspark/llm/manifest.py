"""Merkle manifest of a dataset, with nested-interval labels.

The leaves of each group (a language, say) are ranked; a node of level l covers an interval [lo, hi) of leaf ranks that
starts at a multiple of 2 ** l. Intervals of one group nest, so a node's ancestors are those nodes whose intervals contain
its own, and a node's sibling is the difference between its parent's interval and its own. Every two consecutive nodes
become their parent, the digest of both; a last one alone becomes its own digest. The groups' tops are the leaves of one
more tree, whose top is the root.

Levels are kept in buckets of ``HEIGHT``: a block is a row with the nodes of one bucket above 2 ** HEIGHT consecutive
nodes, so no row holds more than 2 ** (HEIGHT + 1) nodes. Blocks are made bottom up, one shuffle a bucket, each with a
256th of the rows of the one below. Then proofs come top down: each block joins the block of the next bucket whose interval
contains its own, and at last each leaf its own block. So a leaf is joined once however deep its tree is, and takes the
siblings of all its ancestors from there.

Ranks come from a range partitioning by (group, order, digest, row), with the number of leaves that each group has in each
partition: nothing is ordered in one task, and a group with all the rows, or equal rows, are spread like any other. Texts are read
once; from then on only digests are stored and shuffled.

Defined results: a null value is `-` in a leaf; a null group is one of its own and comes first; null ids come before
others; leaves of one id are ordered by digest, equal rows are leaves of their own (interchangeable ones); a leaf
without siblings has the digest of nothing as proof; a very long text only takes time; columns that are not named in the leaf
do not matter, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.tables import partitions, removed, small, table, written

HEIGHT = 8
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "array<array<struct<lo:bigint,hi:bigint,digest:string>>>"
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def value(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**columns: Column) -> Column:
    """The digest of a row's named values, in their order."""
    return digest(*[value(c) for c in columns.values()])


def _named(group: Column) -> Column:
    """A group as a string without null, ordered like UTF-8 bytes with null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(leaves: DataFrame) -> DataFrame:
    """(grp, ord, digest, ...) -> with rank, from 0, and size, the number of leaves of the group; in the shared folder."""
    spark = leaves.sparkSession
    # a row's number settles ties, and is stored so that it stays the same if a task runs again
    told = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("grp"), F.col("ord").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = told.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "dealt")
    counts = dealt.groupBy(F.col("grp").alias("c_grp"), F.col("part").alias("c_part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    # a row a partition and group: a group's window has at most as many rows as there are partitions
    own = Window.partitionBy("c_grp")
    before = own.orderBy("c_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = written(counts.withColumns({"before": F.sum("n").over(before) - F.col("n"), "size": F.sum("n").over(own)}), "starts")
    placed = dealt.join(small(starts, 96), (F.col("grp") == F.col("c_grp")) & (F.col("part") == F.col("c_part")))
    out = written(placed.withColumn("rank", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "c_grp", "c_part", "first", "n", "before"), "ranked")
    removed(told, dealt, starts)
    return out


def _width(bucket: int) -> int:
    return 1 << (HEIGHT * bucket)


def _at(nodes: Column, level: Column, place: Column) -> Column:
    return F.get(F.get(nodes, level), place)


def _parents(nodes: Column) -> Column:
    """The digests of every two consecutive nodes, of a last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _blocks(nodes: DataFrame, bucket: int) -> DataFrame:
    """Nodes (grp, place, size, digest) at the bottom of a bucket -> (grp, block, size, lo, hi, nodes by level, top)."""
    width = _width(bucket)
    below = F.floor((F.col("size") - 1) / width) + 1
    height = F.least(F.when(below > 1, F.length(F.bin(below - 1))).otherwise(0), F.lit(HEIGHT))
    levels = F.when(F.col("height") > 0, F.sequence(F.lit(1), F.col("height"))).otherwise(F.array().cast("array<int>"))
    held = nodes.groupBy("grp", F.floor(F.col("place") / (1 << HEIGHT)).alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("own"))
    held = held.withColumn("height", height).withColumn("bottom", F.transform("own", lambda x: x["digest"]))
    grown = held.withColumn("digests", F.aggregate(levels, F.array("bottom"), lambda up, _: F.concat(up, F.array(_parents(F.element_at(up, -1))))))
    lo = F.col("block") * (width << HEIGHT)
    hi = F.least(lo + (width << HEIGHT), "size")

    def labelled(level: Column, l: Column) -> Column:
        step = F.lit(width).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), l)

        def node(d: Column, i: Column) -> Column:
            start = F.col("lo") + i * step
            return F.struct(start.alias("lo"), F.least(start + step, F.col("hi")).alias("hi"), d.alias("digest"))

        return F.transform(level, node)

    out = grown.withColumns({"lo": lo, "hi": hi}).withColumn("nodes", F.transform("digests", labelled).cast(_NODE))
    return out.select("grp", "block", "size", "lo", "hi", "nodes", F.element_at(F.element_at("digests", -1), 1).alias("top"))


def _path(nodes: Column, lo: Column, bucket: int) -> Column:
    """The siblings of the ancestors, in a block, of the node that starts at leaf ``lo``, by level: (left, right), '' for none."""
    start = F.floor((lo - _at(nodes, F.lit(0), F.lit(0))["lo"]) / _width(bucket)).cast("int")

    def step(l: Column) -> Column:
        place = F.call_function("shiftright", start, l)
        own, parent = _at(nodes, l, place), _at(nodes, l + 1, F.call_function("shiftright", place, F.lit(1)))
        # what the parent's interval has before or after the own one is the sibling's
        left = F.when(parent["lo"] < own["lo"], _at(nodes, l, place - 1)["digest"]).otherwise("")
        right = F.when(own["hi"] < parent["hi"], _at(nodes, l, place + 1)["digest"]).otherwise("")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.when(F.size(nodes) > 1, F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), step)).otherwise(F.array()).cast(_PATH)


def folded(digest_of_leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest_of_leaf, lambda own, s: digest(s["left"], own, s["right"]))


def proof(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _climb(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The blocks of ranked leaves, bucket by bucket; ``most`` is the size of the largest group."""
    buckets = [written(_blocks(leaves.select("grp", F.col("rank").alias("place"), "size", "digest"), 0), "blocks")]
    while most > (width := _width(len(buckets))):
        tops = buckets[-1].where(F.col("size") > width).select("grp", F.col("block").alias("place"), "size", F.col("top").alias("digest"))
        buckets.append(written(_blocks(tops, len(buckets)), "blocks"))
    return buckets


def _inside(children: DataFrame, blocks: DataFrame, bucket: int) -> DataFrame:
    """``children`` (grp, lo, hi, ...) each with the block of ``bucket`` whose interval contains theirs: p_nodes, p_path, p_top, p_root."""
    up = blocks.select(F.col("grp").alias("p_grp"), F.col("block").alias("p_block"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("nodes").alias("p_nodes"), F.col("path").alias("p_path"), F.col("subroot").alias("p_subroot"), F.col("root").alias("p_root"))
    # intervals of a bucket start at multiples of its width, so a child's own start tells the only one that may contain it
    same = (F.col("grp") == F.col("p_grp")) & (F.floor(F.col("lo") / _width(bucket + 1)) == F.col("p_block"))
    return children.join(up, same & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))


def _descend(buckets: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The lowest blocks with path (from the block's top to the root), subroot and root. ``above`` has (a_grp, a_path,
    a_root) of each group's top; without it the top is the root."""
    done = None
    for bucket in range(len(buckets) - 1, -1, -1):
        whole = buckets[bucket].where(F.col("size") <= _width(bucket + 1))
        if above is None:
            now = whole.withColumns({"path": F.array().cast(_PATH), "subroot": F.col("top"), "root": F.col("top")})
        else:
            now = whole.join(above, F.col("grp") == F.col("a_grp")).withColumns({"path": F.col("a_path"), "subroot": F.col("top"), "root": F.col("a_root")}).drop("a_grp", "a_path", "a_root")
        if done is not None:
            part = _inside(buckets[bucket].where(F.col("size") > _width(bucket + 1)), done, bucket + 1)
            part = part.withColumns({"path": F.concat(_path(F.col("p_nodes"), F.col("lo"), bucket + 1), F.col("p_path")), "subroot": F.col("p_subroot"), "root": F.col("p_root")})
            now = now.unionByName(part.select(*now.columns))
        done = written(now, "proven")
    return done


def _tree(leaves: DataFrame) -> list[DataFrame]:
    return _climb(leaves, leaves.agg(F.max("size")).first()[0] or 0)


def _tops(buckets: list[DataFrame]) -> DataFrame:
    """(grp, digest) of each group's top."""
    return reduce(DataFrame.unionByName, [b.where(F.col("size") <= _width(k + 1)).select("grp", F.col("top").alias("digest")) for k, b in enumerate(buckets)])


@dataclass
class Manifest:
    """Ranked leaves; the blocks of their groups' trees and of the root tree, by bucket; and the lowest blocks with paths up."""

    leaves: DataFrame
    groups: list[DataFrame]
    roots: list[DataFrame]
    lowest: DataFrame

    def nodes(self) -> DataFrame:
        """Every node of the groups' trees: grp ('' for the null one, else '=' and its name), level, lo, hi, digest. A bucket's
        top level is the bottom of the next one and comes from there."""
        parts = []
        for k, blocks in enumerate(self.groups):
            level = blocks.select("grp", "size", F.posexplode("nodes").alias("l", "row")).where((F.col("l") < HEIGHT) | (F.col("size") <= _width(k + 1)))
            parts.append(level.select("grp", (F.col("l") + HEIGHT * k).alias("level"), F.inline("row")))
        return reduce(DataFrame.unionByName, parts)

    def proofs(self) -> DataFrame:
        """The leaves with path, subroot and root."""
        one = self.leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
        held = _inside(one, self.lowest, 0)
        out = held.withColumn("path", F.concat(_path(F.col("p_nodes"), F.col("lo"), 0), F.col("p_path")))
        return out.select(*self.leaves.columns, "path", F.col("p_subroot").alias("subroot"), F.col("p_root").alias("root"))


def build(leaves: DataFrame) -> Manifest:
    """``leaves``: (grp, ord, digest) and columns to carry, none of them named rank, size, path, subroot or root."""
    placed = ranked(leaves.withColumn("grp", _named(F.col("grp"))))
    groups = _tree(placed)
    subroots = ranked(_tops(groups).select(F.lit("").alias("grp"), F.col("grp").alias("ord"), "digest"))
    roots = _tree(subroots)
    ends = _inside(subroots.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1}), _descend(roots, None), 0)
    above = written(ends.select(F.col("ord").alias("a_grp"), F.concat(_path(F.col("p_nodes"), F.col("lo"), 0), F.col("p_path")).alias("a_path"), F.col("p_root").alias("a_root")), "above")
    return Manifest(placed, groups, roots, _descend(groups, above))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    own = {c: F.col(c) for c in LEAF}
    tampered = leaf(**own | {"n_chars": F.col("n_chars") + 1})
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("ord"), leaf(**own).alias("digest"), F.when(hit, tampered).alias("tampered"))
    proven = build(leaves).proofs().withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return proven.select(F.col("ord").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE told AS (SELECT row_number() OVER () AS id, lang, doc_id, n_chars,
  coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
  coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail,
  list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b:
    list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
digests AS (SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1) || tail) END AS tampered FROM told),
leaves AS (SELECT *, coalesce('=' || lang, '') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM digests),
nodes AS (SELECT grp, 0 AS level, place, size, leaf AS digest FROM leaves
  UNION ALL SELECT grp, level + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE size > 1 GROUP BY grp, level, place // 2),
subroots AS (SELECT grp, level AS height, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (SELECT 0 AS level, place, size, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE size > 1 GROUP BY level, place // 2),
steps AS (SELECT id, n.level, n.digest AS sibling, n.place < xor(l.place >> n.level, 0) AS is_left FROM leaves l JOIN nodes n ON n.grp = l.grp AND n.place = xor(l.place >> n.level, 1) AND n.size > 1
  UNION ALL SELECT id, s.height + t.level, t.digest, t.place < (s.place >> t.level) FROM leaves l JOIN subroots s ON s.grp = l.grp JOIN tops t ON t.place = xor(s.place >> t.level, 1) AND t.size > 1),
depth AS (SELECT l.id, s.height + (SELECT max(level) FROM tops) AS depth FROM leaves l JOIN subroots s ON s.grp = l.grp),
proofs AS (SELECT id, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (id) GROUP BY id),
folds AS (SELECT id, 0 AS level, coalesce(tampered, leaf) AS digest FROM leaves
  UNION ALL SELECT f.id, f.level + 1, sha256(CASE WHEN is_left THEN sibling ELSE '' END || f.digest || CASE WHEN is_left THEN '' ELSE coalesce(sibling, '') END)
  FROM folds f JOIN depth d ON d.id = f.id AND f.level < d.depth LEFT JOIN steps s ON s.id = f.id AND s.level = f.level)
SELECT doc_id, leaf, subroot, top.digest AS root, proof_sha256, f.digest AS folded_root, f.digest = top.digest AS verified
FROM leaves l JOIN subroots s ON s.grp = l.grp JOIN proofs p ON p.id = l.id JOIN depth d ON d.id = l.id JOIN folds f ON f.id = l.id AND f.level = d.depth
JOIN tops top ON top.size = 1
"""
