"""N-gram Jaccard join by signature trees.

A document is the set of its distinct word shingles (64-bit hashes; A-Z folded). Documents link where the Jaccard
similarity of their sets reaches ``percent``. Copies, documents of one set, are one node. The components are exact, but the
links are not enumerated: pairs of nodes known to be in one component are never tried, so the search yields some links that
span each component, neither all pairs nor their number. The method:

1. Shingles are put in one order for all documents, rare ones first, so that passages many documents share come last:
   by a sketch of counts, whose size goes with the input up to a bound, and, where shingles are still met by more nodes of
   different components than a cell holds, by exact counts of the shingles of those nodes. Linked sets share one of
   the first n - ceil(t n) + 1 shingles of both: documents meet where they share one of these.
2. The nodes that meet at a shingle form a signature tree: leaves hold a bitmap of the set's shingles and its size,
   inner nodes the OR of their children's bitmaps and the range of their sizes. A dual traversal drops pairs of nodes
   whose sizes do not fit or whose largest possible overlap, the common bits plus what bits may hide, is too small.
   (Up to ``FANOUT`` nodes are one leaf level, so that many such groups are compared at once.)
3. A task never emits pairs: of each node that may link with another component it tells the least component that such
   pairs lead to. What these connect is a cluster. Its nodes meet once, by a tree of their whole sets, computed anew from the
   texts, where the pairs left are verified exactly; links that join no components are not emitted either. So all rows
   between stages grow with the nodes, not with pairs.

The first round takes a few shingles a document, which joins most of a large family; the second takes all shingles at
which different components still meet. A group of more than ``CELL`` nodes is dealt into blocks, which are searched each
for themselves; if there was one, a third round lets every two blocks meet, nodes of the group's main component only
with the others. That makes the components exact.

Defined results: null, empty and wordless texts have an empty set and link with nothing; equal rows are copies; a null
doc_id takes part, but names no component (a component without any id is null); a repeated doc_id with other text is
another node; an empty table gives an empty result; other columns never matter. A very long text costs memory in
proportion to its own words, in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words
from quillspark.llm.components import components
from quillspark.llm.tables import held, partitions, released, removed, small, table, written

SHINGLE, PERCENT = 5, 80
CELL, FANOUT, MOST_BITS = 1024, 16, 8192
#: Shingles of the texts that one block of a cell verifies at once, but for a single longer text.
SHINGLES = 1 << 21
#: The sketch of counts: 2 ** 20 counters or, for more shingles, so many that each counts about ``MEAN`` of them, but 2 ** 24 at
#: most (a byte each where they are sent); in parts of 2 ** 12.
_BITS, _MOST_BITS, _PART, MEAN = 20, 24, 1 << 12, 512
_U = np.uint64


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ordered distinct hashes of each text) for each block of a string column."""
    for row, data, offsets in words.blocks(column):
        hashes, at = words.shingle_hashes(*words.word_hashes(data, offsets, fold=True), k)
        yield row, [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_bits(docs: DataFrame) -> int:
    """The size of the sketch, by the bytes of all texts: about one shingle in six bytes."""
    n = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    return min(max((n // MEAN).bit_length(), _BITS), _MOST_BITS)


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """A class for each counter of the sketch: 0 for common counts, higher ones for more frequent shingles."""
    bits = sketch_bits(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                at, n = np.unique((np.concatenate(sets) >> _U(64 - bits)).astype(np.int64), return_counts=True)
                total[at] += n.astype(np.int32)
        held = [i for i in range(0, 1 << bits, _PART) if total[i : i + _PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // _PART for i in held], pa.int32()), pa.array([total[i : i + _PART].astype(np.int64).tobytes() for i in held], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        # what comes to the driver: a logarithm of each counter, and each part's sum
        logs = [np.rint(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], names=["part", "logs", "total"])

    n = 1 << bits
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "part int, counts binary")
    # a row a task and part: the sums are as even as the tasks, and of fixed size
    parts = counted.repartition(min(partitions(docs.sparkSession), n // _PART), "part").mapInArrow(add, "part int, logs binary, total long").collect()
    classes, total = np.zeros(n, np.uint8), 0
    for part, logs, own in parts:
        classes[part * _PART : (part + 1) * _PART] = np.frombuffer(logs, np.uint8)
        total += own
    # quarters of powers of two above four times the usual count
    usual = 4 * np.log2(max(total / n, 1.0))
    return np.clip((classes - usual) / 4, 0, 31).astype(np.uint8) * (classes > usual + 8)


#: The common shingles that are sent to all tasks, 16 bytes each, the most common ones first.
_COMMON = 1 << 20


def prefix(shingles: np.ndarray, classes: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The shingles of which linked sets share one, rarest first; ``common`` ones, counted exactly, come last of all."""
    n = len(shingles)
    p = n - -(-percent * n // 100) + 1
    rank = classes[(shingles >> _U(64 - (len(classes).bit_length() - 1))).astype(np.int64)]
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        rank = np.where(common[0][at] == shingles, common[1][at], rank)
    key = (rank.astype(_U) << _U(58)) | (words.mix(shingles) >> _U(6))
    first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
    return shingles[first[np.argsort(key[first])]][:p]


def common_shingles(nodes: DataFrame, comps: DataFrame, docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Shingles that too many documents of different components share, in order, each with its place in the order of all (above
    the sketch's classes); null where there are none.

    A sketch cannot tell a common shingle from a rare one where all its counters are high. So shingles by which more than
    a cell's nodes outside one component meet are looked for, and where there are some, the shingles of those nodes'
    texts are counted exactly, added up in tasks first."""
    spark = nodes.sparkSession
    placed = nodes.select("node", "firsts").join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    posted = placed.select("node", F.coalesce("component", "node").alias("comp"), F.explode("firsts").alias("token"))
    by_comp = posted.groupBy("token", "comp").agg(F.count("*").alias("c"))
    wide = written(by_comp.groupBy("token").agg((F.sum("c") - F.max("c")).alias("outside")).where(F.col("outside") > CELL).select(F.col("token").alias("h_token")), "wide")
    if wide.isEmpty():
        removed(wide)
        return None
    touched = nodes.select("node", "rep", F.explode("firsts").alias("token")).join(wide, F.col("token") == F.col("h_token"), "left_semi").select("rep").distinct()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(_row(F.col("doc_id"), F.xxhash64("text")).alias("d_rep"), "text")
    texts = rows.join(touched, F.col("d_rep") == F.col("rep"), "left_semi").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                tokens, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(n, pa.int64())], names=["token", "n"])

    counted = texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > CELL)
    found = counted.orderBy(F.desc("n"), "token").limit(_COMMON).collect()
    removed(wide)
    tokens, n = np.array([r["token"] for r in found], np.int64).view(_U), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(tokens)
    return tokens[order], (32 + np.minimum(np.log2(n[order] / CELL), 31)).astype(np.uint8)


def bitmap(shingles: np.ndarray) -> bytes:
    width = min(MOST_BITS, max(64, 1 << int(4 * len(shingles) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(shingles & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int, classes: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, hash of the text, n, node, first shingles, bitmap) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, common))  # 16 MB each at most, whatever the data's size
    schema = "doc_id long, hash long, n long, node long, firsts array<long>, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(2), k):
                firsts = [_signed(prefix(s, shared.value[0], percent, shared.value[1])) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)),
                        batch.column(1).slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts))),
                        pa.array([bitmap(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "hash", "n", "node", "firsts", "bits"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, schema)


class Tree:
    """A signature tree over leaves of one bitmap width. Level 0 holds the leaves, the last level the top nodes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack, comps, comps)]
        while len(self.levels[-1][0]) > FANOUT:
            b, least, most, slack, c0, c1 = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(slack, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))


def _possible(a: tuple, p: np.ndarray, b: tuple, q: np.ndarray, percent: int) -> np.ndarray:
    """Those places where leaves under nodes p of a level and q of another may link, by the bound on their overlap."""
    keep = np.flatnonzero((100 * b[2][q] >= percent * a[1][p]) & (100 * a[2][p] >= percent * b[1][q]) & ~((a[4][p] == a[5][p]) & (b[4][q] == b[5][q]) & (a[4][p] == b[4][q])))
    p, q = p[keep], q[keep]
    common = np.bitwise_count(a[0][p] & b[0][q]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(a[2][p], b[2][q]), common + np.minimum(a[3][p], b[3][q]))
    fits = (100 + percent) * most >= percent * (a[1][p] + b[1][q])
    return keep[fits]


def dual(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leaf of a, leaf of b) of the pairs that may link; each unordered pair once where a is b."""

    def pairs_of(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)

    stack = [(len(a.levels) - 1, len(b.levels) - 1, *pairs_of(len(a.levels[-1][0]), len(b.levels[-1][0])))]
    while stack:
        i, j, p, q = stack.pop()
        if a is b:
            once = p <= q if i == j and i else p < q if i == j else slice(None)
            p, q = p[once], q[once]
        width = max(1, (1 << 22) // (a.levels[0][0].shape[1] or 1))
        if len(p) > width:
            stack += [(i, j, p[s : s + width], q[s : s + width]) for s in range(0, len(p), width)]
            continue
        keep = _possible(a.levels[i], p, b.levels[j], q, percent)
        p, q = p[keep], q[keep]
        if not len(p):
            continue
        if i == 0 and j == 0:
            yield p, q
            continue
        down_a, down_b = (i > 0 and (i >= j or a is b)), (j > 0 and (j >= i or a is b))
        x, y = pairs_of(FANOUT if down_a else 1, FANOUT if down_b else 1)
        p = (p[:, None] * FANOUT + x).ravel() if down_a else np.repeat(p, len(x))
        q = (q[:, None] * FANOUT + y).ravel() if down_b else np.repeat(q, len(x))
        i, j = i - down_a, j - down_b
        real = (p < len(a.levels[i][0])) & (q < len(b.levels[j][0]))
        stack.append((i, j, p[real], q[real]))


class Bitmaps:
    """Bitmaps of several widths (in 64-bit words, powers of two) in one flat array; a wide one folds to fewer bits by OR."""

    def __init__(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy().view(_U)
        self.at, self.width = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8

    def take(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The bitmaps of rows, none narrower than ``width``: bit h of a wider one is bit h mod width."""
        out = np.empty((len(rows), width), _U)
        for w in np.unique(self.width[rows]).tolist():
            own = np.flatnonzero(self.width[rows] == w)
            out[own] = np.bitwise_or.reduce(self.flat[self.at[rows[own]][:, None] + np.arange(w)].reshape(len(own), w // width, width), axis=1)
        return out


class Group:
    """Rows that meet in a cell, by bitmap width, with a signature tree for each width that is asked for."""

    def __init__(self, rows: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bitmaps: Bitmaps) -> None:
        self.bitmaps, self.parts, widths = bitmaps, {}, bitmaps.width[rows]
        for w in np.unique(widths).tolist():
            own = rows[widths == w]
            own = own[np.lexsort((own, sizes[own], comps[own]))]
            self.parts[w] = (own, comps[own], sizes[own])
        self.trees: dict[tuple[int, int], Tree] = {}

    def tree(self, w: int, folded: int) -> Tree:
        if (w, folded) not in self.trees:
            rows, comps, sizes = self.parts[w]
            self.trees[w, folded] = Tree(self.bitmaps.take(rows, folded), sizes, comps)
        return self.trees[w, folded]


def meetings(left: Group, right: Group, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) arrays of pairs of different components that may link between two groups (or in one)."""
    for w, (rows, comps, _) in left.parts.items():
        for v, (rows2, comps2, _) in right.parts.items():
            if left is right and v < w:
                continue
            least = min(w, v)
            for p, q in dual(left.tree(w, least), right.tree(v, least), percent):
                differ = comps[p] != comps2[q]
                if differ.any():
                    yield rows[p[differ]], rows2[q[differ]]


def joined(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each at most its index, a label its own) after joining the sets of x and y pairwise: the least index of each set."""
    while True:
        a, b = labels[x], labels[y]
        differ = np.flatnonzero(a != b)
        if not len(differ):
            return labels
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (next_ := labels[labels]).tobytes() != labels.tobytes():
            labels = next_


def _codes(group: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number of each row's component in its group, ordered by component; the component of each number)."""
    order = np.lexsort((comps, group))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(comps[order]) != 0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, comps[order][new]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole cells at a time: (rows, where each cell begins and the last ends). The rows come sorted by key and cell, the first two columns."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = (batch.column(i).to_numpy() for i in (0, 1))
        if rest and (rest[0].column(0)[0].as_py(), rest[0].column(1)[0].as_py()) == (key[-1], cell[-1]):
            rest.append(batch)
            continue
        last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0], cell[0]) != (key[-1], cell[-1]) else 0
        whole, rest = pa.Table.from_batches([*rest, batch.slice(0, last)]), [batch.slice(last)]
        if whole.num_rows:
            yield whole, _edges(whole)
    if rest:
        whole = pa.Table.from_batches(rest)
        yield whole, _edges(whole)


def _edges(rows: pa.Table) -> np.ndarray:
    key, cell = (rows.column(i).to_numpy() for i in (0, 1))
    return np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1, [len(key)]])


def _sides(start: int, end: int, side: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bitmaps: Bitmaps) -> tuple[Group, Group] | None:
    """What is to meet in a cell: its rows among each other, or where two blocks meet, those of one with those of the other."""
    rows = np.arange(start, end)
    left, right = (rows[side[start:end] == s] for s in (0, 1))
    if not len(left):
        return None
    first = Group(left, comps, sizes, bitmaps)
    return first, Group(right, comps, sizes, bitmaps) if len(right) else first


def _small_cells(edges: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of all pairs in cells of up to ``FANOUT`` rows, each one leaf of a tree."""
    p, q = [], []
    count = np.diff(edges)
    for m in range(2, FANOUT + 1):
        starts = edges[:-1][count == m]
        i, j = np.triu_indices(m, 1)
        p.append((starts[:, None] + i).ravel())
        q.append((starts[:, None] + j).ravel())
    p, q = np.concatenate(p), np.concatenate(q)
    two = np.repeat(np.maximum.reduceat(side, edges[:-1]), count)
    fits = np.where(two[p] == 1, side[p] != side[q], True)
    return p[fits], q[fits]


def _may_link(p: np.ndarray, q: np.ndarray, sizes: np.ndarray, bitmaps: Bitmaps, percent: int) -> np.ndarray:
    """Which of the pairs of rows may link, by size and by the common bits and what bits may hide."""
    fits = np.flatnonzero((100 * sizes[q] >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes[q]))
    least = np.minimum(bitmaps.width[p[fits]], bitmaps.width[q[fits]])
    found = np.zeros(len(p), bool)
    for w in np.unique(least).tolist():
        own, step = fits[least == w], max(1, (1 << 20) // w)
        for part in (own[s : s + step] for s in range(0, len(own), step)):
            a, b, na, nb = bitmaps.take(p[part], w), bitmaps.take(q[part], w), sizes[p[part]], sizes[q[part]]
            bits = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            most = np.minimum(np.minimum(na, nb), bits(a & b) + np.minimum(na - bits(a), nb - bits(b)))
            found[part] = (100 + percent) * most >= percent * (na + nb)
    return found


MET = "node long, comp long, root long, split boolean"


def _search(percent: int):  # noqa: ANN202
    """The task's side of the search: sorted rows (token, cell, side, node, comp, n, bits, split) -> those nodes that may
    link with one of another component in their cell, each with the least component that such pairs lead to there; and a
    row of nulls that tells if a group was split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _cells(batches):
            side, node, comps, sizes = (rows.column(i).to_numpy() for i in range(2, 6))
            bitmaps = Bitmaps(rows.column(6))
            code, of_code = _codes(np.repeat(np.arange(len(edges) - 1), np.diff(edges)), comps)
            labels, touched = np.arange(len(of_code)), np.zeros(len(node), bool)
            p, q = _small_cells(edges, side)
            p, q = (x[comps[p] != comps[q]] for x in (p, q))
            fits = _may_link(p, q, sizes, bitmaps, percent)
            pairs = [(p[fits], q[fits])]
            for i in np.flatnonzero(np.diff(edges) > FANOUT).tolist():
                sides = _sides(edges[i], edges[i + 1], side, comps, sizes, bitmaps)
                for p, q in [] if sides is None else meetings(*sides, percent):
                    touched[p] = touched[q] = True
                    labels = joined(labels, code[p], code[q])
            for p, q in pairs:
                touched[p] = touched[q] = True
                labels = joined(labels, code[p], code[q])
            split = pc.any(rows.column(7)).as_py()
            out = [pa.array([*x[touched].tolist(), *[None] * split], pa.int64()) for x in (node, comps, of_code[labels[code]])]
            yield pa.RecordBatch.from_arrays([*out, pa.array([False] * int(touched.sum()) + [True] * split, pa.bool_())], names=["node", "comp", "root", "split"])

    return run


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    ends = np.cumsum([0, *map(len, others)])
    flat = np.concatenate(others)
    hits = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hits, ends[:-1], dtype=np.int64)


def _cell_links(sides: tuple[Group, Group] | None, sets: list[np.ndarray], code: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links (row, row) that span what a cell's exact links connect; pairs whose components are joined by then are not tried."""
    if sides is None:
        return
    labels, sizes = np.arange(code.max() + 1), np.array([len(s) for s in sets])
    for p, q in meetings(*sides, percent):
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        for pivot, partners in zip(p[first := np.flatnonzero(np.diff(p, prepend=-1))].tolist(), np.split(q, first[1:]), strict=True):
            for some in (partners[s : s + CELL] for s in range(0, len(partners), CELL)):
                some = some[labels[code[some]] != labels[code[pivot]]]
                if not len(some):
                    continue
                common = _overlaps(sets[pivot], [sets[i] for i in some.tolist()])
                for other in some[100 * common >= percent * (sizes[pivot] + sizes[some] - common)].tolist():
                    if labels[code[other]] != labels[code[pivot]]:
                        labels = joined(labels, code[[pivot]], code[[other]])
                        yield pivot, other


def _verify(k: int, percent: int):  # noqa: ANN202
    """The task's side of the verification: sorted rows (cluster, cell, side, node, comp, text) -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _cells(batches):
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = rows.slice(start, end - start)
                side, node, comps = (own.column(i).to_numpy() for i in (2, 3, 4))
                sets = [s for _, part in shingle_sets(own.column(5), k) for s in part]
                bitmaps = Bitmaps(pa.array([bitmap(s) for s in sets], pa.binary()))
                code, _ = _codes(np.zeros(len(node), np.int64), comps)
                found = list(_cell_links(_sides(0, len(node), side, comps, np.array([len(s) for s in sets]), bitmaps), sets, code, percent))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(node[[x[i] for x in found]]) for i in (0, 1)], names=["u", "v"])

    return run


def _in_cells(rows: DataFrame, key: str, weight: str | None, every: bool, percent: int = 0) -> DataFrame:
    """The rows (key, node, comp, ...) of groups with more than one component, with ``cell`` and ``side``.

    A group of up to ``CELL`` nodes and ``SHINGLES`` of weight is one cell. A larger one is dealt into blocks by node. Unless
    ``every``, blocks are cells, and each node is in one. Else every two nodes that are not both of the group's main
    component meet: those outside it are in blocks of their own; two blocks meet in the cell of their numbers, and a block
    meets each block of the main component. With ``percent`` the rows have n and rem, the shingles from this one on: two
    nodes whose first common shingle this is share no more than the lesser rem, so a group of two that need more is left out."""
    heavy = F.lit(0) if weight is None else F.col(weight)
    parts = lambda c, w: F.ceil(F.greatest(c / CELL, w / SHINGLES, F.lit(1))).cast("int")
    whole = [F.min("comp").alias("least"), F.max("comp").alias("most")]
    size = [F.sum("n").alias("s"), F.min("rem").alias("r")] if percent else []
    size_again = [F.sum("s").alias("s"), F.min("r").alias("r")] if percent else []
    fits = (F.col("least") != F.col("most")) & ((F.col("all_c") > 2) | ((100 + percent) * F.col("r") >= percent * F.col("s")) if percent else F.lit(True))
    if not every:
        groups = rows.groupBy(key).agg(*whole, *size, F.count("*").alias("all_c"), F.sum(heavy).alias("w")).where(fits).select(F.col(key).alias("g_key"), parts(F.col("all_c"), F.col("w")).alias("parts"))
    else:
        by_comp = rows.groupBy(key, "comp").agg(F.count("*").alias("c"), F.sum(heavy).alias("w"), *size)
        groups = by_comp.groupBy(key).agg(*whole, *size_again, F.sum("c").alias("all_c"), F.sum("w").alias("all_w"), F.max(F.struct("c", "w", "comp")).alias("top"))
        groups = groups.where(fits).select(F.col(key).alias("g_key"), F.col("top.comp").alias("top"), parts(F.col("all_c"), F.col("all_w")).alias("parts"), parts(F.col("all_c") - F.col("top.c"), F.col("all_w") - F.col("top.w")).alias("rest"), parts(F.col("top.c"), F.col("top.w")).alias("main"))
    met = rows.join(groups, F.col(key) == F.col("g_key"))
    hashed = lambda n: F.pmod(F.xxhash64("node"), n).cast("long")
    if not every:
        return met.select(*rows.columns, hashed(F.col("parts")).alias("cell"), F.lit(0).alias("side"), "parts")
    of = lambda i, j, side: F.struct((i * (1 << 31) + j).alias("cell"), side.cast("int").alias("side"))
    own, upto = hashed(F.col("rest")), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("long"))
    with_rest = F.transform(upto(F.col("rest")), lambda j: of(F.least(own, j), F.greatest(own, j), own > j))
    with_main = F.transform(upto(F.col("main")), lambda j: of(own, F.col("rest") + j, F.lit(0)))
    from_main = F.transform(upto(F.col("rest")), lambda i: of(i, F.col("rest") + hashed(F.col("main")), F.lit(1)))
    whole = F.array(of(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0)))
    to = F.when(F.col("parts") == 1, whole).when(F.col("comp") == F.col("top"), from_main).otherwise(F.concat(with_rest, with_main))
    return met.select(*rows.columns, F.inline(to), "parts")


def _round(nodes: DataFrame, docs: DataFrame, comps: DataFrame | None, few: bool, every: bool, k: int, percent: int) -> tuple[DataFrame, bool]:
    """(links found between components, whether some group was split). ``few``: only some of the first shingles meet."""
    spark = nodes.sparkSession
    known = nodes.select("node", "n", "firsts").withColumn("comp", F.col("node"))
    if comps is not None:
        known = known.drop("comp").join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").withColumn("comp", F.coalesce("component", "node"))
    posted = known.select("node", "comp", "n", F.posexplode("firsts").alias("place", "token"))
    if few:
        posted = posted.where((F.col("place") < 2) | (F.pmod("token", F.lit(16)) == 0))
    posted = posted.select("token", "node", "comp", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("place")).cast("int").alias("rem"))
    met = written(_in_cells(posted, "token", None, every, percent).drop("n", "rem"), "postings")
    signed = nodes.select(F.col("node").alias("s_node"), "n", "bits")
    full = met.join(signed, F.col("node") == F.col("s_node")).select("token", "cell", "side", "node", "comp", "n", "bits", F.col("parts") > 1)
    dealt = full.repartition(partitions(spark), "token", "cell").sortWithinPartitions("token", "cell")
    found = written(dealt.mapInArrow(_search(percent), MET).distinct(), "met")
    removed(met)
    split = not every and not found.where("split").isEmpty()
    pairs = found.where("NOT split")
    clusters = components(pairs.select(F.col("comp").alias("u"), F.col("root").alias("v")))
    active = pairs.select("node", "comp").distinct().join(clusters.withColumnRenamed("node", "k_comp"), F.col("comp") == F.col("k_comp"), "left")
    named = nodes.select(F.col("node").alias("n_node"), "n", "rep")
    placed = active.select("node", "comp", F.coalesce("component", "comp").alias("cluster")).join(named, F.col("node") == F.col("n_node")).drop("n_node")
    placed = written(_in_cells(placed, "cluster", "n", every), "placed")
    links = written(_texts(placed, docs).repartition(partitions(spark), "cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(_verify(k, percent), "u long, v long"), "links")
    split = split or not every and not placed.where("parts > 1").isEmpty()
    removed(found, placed)
    return links, split


def _texts(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(cluster, cell, side, node, comp, text): each placed node with the text of the row that stands for it."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(_row(F.col("doc_id"), F.xxhash64("text")).alias("d_rep"), "text")
    one = rows.join(small(placed.select("rep"), 48), F.col("d_rep") == F.col("rep"), "left_semi").groupBy("d_rep").agg(F.first("text").alias("text"))
    return placed.join(one, F.col("rep") == F.col("d_rep")).select("cluster", "cell", "side", "node", "comp", "text")


def _row(doc_id: Column, hashed: Column) -> Column:
    """What tells a row from others: its doc_id, null ones last, and its text's hash."""
    return F.struct(doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), hashed.alias("hash"))


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, hash, n, node) of each row, and (w_node, component_id, first, n_copies) of each node, where
    ``first`` tells the component's first row."""
    docs = docs.select("doc_id", "text")
    classes = rarity(docs, k)
    signed = written(signatures(docs, k, percent, classes), "signatures")
    full = signed.where("n > 0")
    rep = F.min(_row(F.col("doc_id"), F.col("hash")))
    nodes = written(full.groupBy("node").agg(F.min("doc_id").alias("id"), rep.alias("rep"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("firsts").alias("firsts"), F.first("bits").alias("bits")), "nodes")
    rows = written(signed.select("doc_id", "hash", "n", "node"), "rows")
    removed(signed)
    links, _ = _round(nodes, docs, None, True, False, k, percent)
    comps = components(links)
    common = common_shingles(nodes, comps, docs, k)
    if common is not None:
        # all sets are ordered anew, as the order must be one for all documents
        again = signatures(docs, k, percent, classes, common).where("n > 0").groupBy(F.col("node").alias("o_node")).agg(F.first("firsts").alias("firsts"))
        nodes, old = written(nodes.drop("firsts").join(again, F.col("node") == F.col("o_node")).drop("o_node"), "nodes"), nodes
        removed(old)
    split, every = True, False
    while split:
        new, split = _round(nodes, docs, comps, False, every, k, percent)
        links, every = links.unionByName(new), True
        comps = components(links)
    of_node = nodes.select("node", "id", "rep", "n_copies").join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    of_node = of_node.select("node", "id", "rep", "n_copies", F.coalesce("component", "node").alias("component"))
    least = of_node.groupBy("component").agg(F.min("id").alias("component_id"), F.min("rep").alias("first")).withColumnRenamed("component", "l_component")
    found = written(of_node.join(least, F.col("component") == F.col("l_component")).select(F.col("node").alias("w_node"), "component_id", "first", "n_copies"), "components")
    removed(nodes)
    return rows, found


def linked_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) of each row: copies counts the rows with the same set."""
    rows, found = _components(docs, k, percent)
    placed = rows.join(found, (F.col("node") == F.col("w_node")) & (F.col("n") > 0), "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def without_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs``, with all their columns, with one row of each component: that with the least doc_id (a null one last) and text hash.

    Rows without words link with nothing and stay. Of rows with one doc_id and one text one stays."""
    rows, found = _components(docs, k, percent)
    own = rows.where("n > 0").join(found, F.col("node") == F.col("w_node")).select(_row(F.col("doc_id"), F.col("hash")).alias("row"), "first")
    gone = written(own.groupBy("row", "first").agg(F.count("*").alias("rows")).where("row <> first OR rows > 1").select(F.col("row").alias("g_row"), (F.col("row") == F.col("first")).alias("again")), "gone")
    removed(rows, found)
    own = held(docs, "doc_id", "text")
    marked = own.withColumn("g_key", _row(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = marked.join(small(gone, 48), F.col("g_key") == F.col("g_row"), "left_anti").select(*own.columns)
    again = gone.where("again")
    if not again.isEmpty():
        repeated = marked.join(small(again.select("g_row"), 48), F.col("g_key") == F.col("g_row"), "left_semi").select(*own.columns)
        kept = kept.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return released(kept, docs, "doc_id", "text")


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), k=4, percent=85).drop("n_copies")
