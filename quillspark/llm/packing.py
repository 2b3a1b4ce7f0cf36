"""Best-fit packing of documents' tokens into sequences of a fixed capacity.

A document longer than the capacity is cut into full pieces and a rest. Pieces are range-sorted by length, longest
first, and packed in bulk-synchronous rounds. Pieces of one length are alike, and so are sequences with one gap, so a
round works on classes: a class of pieces (length, number) and a class of gaps (gap, a range of sequences). In each
round every class of pieces, from the longest, sweeps to its successor, the least gap class that it fits in; conflicts
are settled by rank (longer pieces first, and within a class by the rank of the piece), the gaps are updated, and the
rounds go on until nothing is left. What no gap holds opens new sequences.

There are at most ``capacity`` classes of pieces and as many of gaps, whatever the size of the data, so the sweeps run
over classes, on the driver, and not over pieces; what they give out are places (a length, a range of ranks, a range of
sequences), whose number levels off with the classes (28,000 for 500,000 pieces of 4,093 lengths). Spark counts the
classes, ranks every piece inside its class (salted by the class's count, so that a class that holds a third of all rows
is not one task's), and joins pieces with the places. The number of sequences is that of best fit on lengths in
descending order where pieces are small against the capacity, and may be a few more where few lengths occur.

Defined results: a null or empty text is the closing id alone; equal rows are packed one by one; a null or repeated
doc_id is packed like any other; a very long text is encoded whole, in one task, and cut; an empty table gives an empty
result; other columns stay out of the way."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.tables import table, written

CAPACITY, END_ID = 4096, 1
# Words whose ids a Python process keeps, in two halves: a full one becomes the former, and the one before it goes.
KEPT_WORDS = 600_000
#: Bytes of text that are encoded together.
PORTION = 1 << 21
#: Pieces of one length that one task ranks, about.
_RANKED = 1 << 16
#: Texts on which ids by word must equal ids of the whole, or every text is encoded whole.
_PROBES = ("The quick (brown) fox's 12,5 % -- e.g. <tag> naïve ÜBER\tstraße!?\n\nfin.", "a", " a  b ", "don't x_y z--- ...", "日本 語 text, ок")
# A word that ends in letters or digits of Latin-1, and the punctuation after it ("<" may begin a special token).
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
_TAIL = re.compile(r"([^<]*[a-z0-9\xdf-\xf6\xf8-\xff])([!-/:;=?@\[-`{-~]+)")


def _default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts as little-endian 32-bit bytes. Where white space parts words for the tokenizer, as probes tell, ids are
    kept by word; else each text is encoded whole."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.known = Tokenizer.from_file(path), kept, {"": b""}
        self.before: dict[str, bytes] = {}
        self.by_word = list(self._by_word(list(_PROBES))) == list(self._whole(list(_PROBES)))

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            text = text.lower()  # as the tokenizer's own lower case, and fewer words to keep
        except UnicodeEncodeError:
            pass
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return text.split(" ")

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        return self._by_word(texts) if self.by_word else self._whole(texts)

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _by_word(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.known) > self.kept // 2:
            self.known, self.before = {"": b""}, self.known
        new = set().union(*split).difference(self.known)
        # words of the former half that are still met move over
        found = {w: self.before[w] for w in new if w in self.before}
        self.known.update(found)
        new.difference_update(found)
        # punctuation at a word's end is tokenized apart from it anyway; so the word itself is often known already
        parts = {w: m.groups() for w in new if (m := _TAIL.fullmatch(w))}
        new.difference_update(parts)
        new.update(x for both in parts.values() for x in both if x not in self.known)
        plain = [w for w in new if _LETTERS.fullmatch(w)]
        new.difference_update(plain)
        # words of letters alone are one unit each to the tokenizer, so many go as one text and are told apart again
        for i in range(0, len(plain), 2_000):
            part = plain[i : i + 2_000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            raw, units = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            edges = [0, *(4 * (np.flatnonzero(units[1:] != units[:-1]) + 1)).tolist(), len(raw)]
            for word, x, y in zip(part, edges[:-1], edges[1:], strict=True):
                self.known[word] = raw[x:y]
        listed = list(new)
        for i in range(0, len(listed), 20_000):
            part = listed[i : i + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = np.array(e.ids, "<u4").tobytes()
        for word, (core, tail) in parts.items():
            self.known[word] = self.known[core] + self.known[tail]
        get = self.known.__getitem__
        for own in split:
            yield b"".join(map(get, own))


_made: dict[str, WordIds] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document."""
    path = vocabulary or _default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _made:
            _made[path] = WordIds(path)
        ids = _made[path]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # a few texts at a time become Python's, whatever the batch holds
            sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)).astype(np.int64))
            at, n = 0, batch.num_rows
            while at < n:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PORTION, "right")))
                names, part = batch.column(0).slice(at, upto - at).to_pylist(), [t or "" for t in batch.column(1).slice(at, upto - at).to_pylist()]
                at = upto
                rows: list[tuple] = []
                for doc_id, made in zip(names, ids.ids(part), strict=True):
                    made += end
                    for k, start in enumerate(range(0, len(made) // 4, capacity)):
                        own = made[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, k, start, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces of the counted lengths: (length, first rank, ranks, first sequence, offset).

    Ranks of a length start from 0. A place gives ranks r, r + 1, ... to sequences s, s + 1, ... at one offset."""
    left = {n: [0, c] for n, c in counts.items() if c}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, number) of sequences with that gap
    sizes: list[int] = []  # gaps that some sequence has, in order
    places, opened = [], 0

    def add(gap: int, first: int, number: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append((first, number))

    def open_new(n: int, number: int) -> None:
        nonlocal opened
        rank, count = left.pop(n)
        places.append((n, rank, number, opened, 0))
        updates.append((capacity - n, opened, number))
        opened += number
        if count > number:
            left[n] = [rank + number, count - number]

    while left:
        updates: list[tuple[int, int, int]] = []
        waiting = False
        for n in sorted(left, reverse=True):
            i = bisect_left(sizes, n)
            while i < len(sizes) and not gaps[sizes[i]]:
                i += 1  # longer pieces took this class in this round
            if i == len(sizes):
                # no gap holds it: longer than half, it opens a sequence at once; of the rest the longest opens as many
                # as it needs, and the others wait for the gaps that this round leaves
                if 2 * n > capacity:
                    open_new(n, left[n][1])
                elif not waiting and not updates:
                    open_new(n, -(-left[n][1] // (capacity // n)))
                waiting = True
                continue
            if waiting and 2 * n <= capacity and sizes[i] != n:
                continue  # a longer piece waits: only perfect fits go before it
            gap = sizes[i]
            rank, count = left.pop(n)
            while count and gaps[gap]:
                first, number = gaps[gap].pop()
                taken = min(count, number)
                if taken < number:
                    gaps[gap].append((first + taken, number - taken))
                places.append((n, rank, taken, first, capacity - gap))
                updates.append((gap - n, first, taken))
                rank, count = rank + taken, count - taken
            if count:
                left[n] = [rank, count]
        for gap in [g for g in sizes if not gaps[g]]:
            del gaps[gap]
        sizes = sorted(gaps)
        for gap, first, number in updates:
            if gap:
                add(gap, first, number)
    return places


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``found`` has doc_id, piece and length, and is read more than once: write it first."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(rounds(counts, capacity), "at_length long, first_rank long, ranks long, first_sequence long, offset long")
    sized = spark.createDataFrame([(n, -(-c // _RANKED)) for n, c in counts.items()], "s_length long, salts long")  # a row a class
    salted = found.join(F.broadcast(sized), F.col("length") == F.col("s_length")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts")).drop("s_length", "salts")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("inside", inside).join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("before")).drop("b_length", "b_salt", "before", "inside", "salt")
    # a place covers its ranks in steps, so that pieces and places meet on equal keys
    step = 1024
    steps = places.withColumn("step", F.explode(F.sequence(F.floor(F.col("first_rank") / step), F.floor((F.col("first_rank") + F.col("ranks") - 1) / step))))
    met = ranked.withColumn("own_step", F.floor(F.col("rank") / step)).join(steps, (F.col("length") == F.col("at_length")) & (F.col("own_step") == F.col("step")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    return met.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).drop("own_step", "step", "at_length", "first_rank", "ranks", "first_sequence", "rank")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    found = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    return packed(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
