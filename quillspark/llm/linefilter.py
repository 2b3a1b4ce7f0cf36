"""Line dedup that can be reversed: sharded cuckoo filters backed by exact reference counts.

The key of a line is the line without white space at both ends, A-Z lower-cased; a key counts once a document. The index of
a corpus is two tables in the shared folder:

* reference counts: a row (128-bit hash of the key, number of documents that have it) for every key of the corpus;
* filters: a row a shard of the keys, with a cuckoo filter (four 16-bit fingerprints a bucket) of the shard's common keys,
  those that ``limit`` documents or more have, and the list of the shard's other keys that the filter takes for common.
  As the counts know every key, that list makes the filter exact for the corpus and not only nearly right.

``inserted`` adds documents: their counts are added up in tasks, then by key, and merged with the table; of each shard
only the keys that cross the limit are put into its filter or taken out of it, which a cuckoo filter allows. ``deleted``
does the same with counts taken away; what was inserted and deleted again leaves the index as it was. So lines come back
into all documents once fewer than ``limit`` have them. Shards hold about ``KEYS`` keys whatever the corpus, and are dealt
anew when the corpus has outgrown them.

``without_common_lines`` looks all lines up. Filters of up to 64 MB in all go to every task, and no text is shuffled; of
larger ones each task holds one: the keys of each document go to their shards, those of busy shards in several parts, and the
common ones come back to the document. A line that a third of all documents share is counted in tasks before it is
shuffled, and its shard has many parts.

Defined results: a null or empty text is one empty line; empty keys never count and their lines stay; every row is a
document of its own, also those of one doc_id, null ones and equal rows; a text whose lines all go becomes empty; very long texts take
memory in proportion to themselves, in one task; other columns are not read, whatever their names; an empty table gives
an empty index and an empty result. Deleting documents that were never inserted is an error where a count would fall
below 0. Two keys of one hash (2 ** -128 a pair) would count as one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.tables import BROADCAST, removed, small, table, written
from quillspark.llm.words import mix

LIMIT, KEYS, SLOTS, KICKS = 10, 1 << 17, 4, 256
#: Distinct keys that a task counts before it emits, and lines of documents that one part of a shard looks up.
HELD, PART = 1 << 18, 1 << 20
_U = np.uint64


def key_of(line: bytes) -> bytes:
    # of bytes, strip() takes 0x20 and 0x09-0x0D, and lower() changes A-Z only
    return line.strip().lower()


def hashes(lines: Iterable[bytes]) -> list[bytes]:
    """The hash of each line's key; of an empty key an empty one."""
    return [xxhash.xxh3_128_digest(k) if (k := key_of(x)) else b"" for x in lines]


def _halves(found: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(found), ">u8").astype(_U).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def places(hi: np.ndarray, lo: np.ndarray, mask: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, bucket, other bucket) of keys. Either bucket and the fingerprint give the other."""
    mark = np.maximum(hi & _U(0xFFFF), _U(1))
    one = lo & np.asarray(mask, _U)
    return mark.astype(np.uint16), one, one ^ (mix(mark) & np.asarray(mask, _U))


class Cuckoo:
    """A set of keys by 16-bit fingerprints in one of two buckets each; equal fingerprints are held as often as they came."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots  # buckets x SLOTS, 0 for none

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        buckets = 1 << max(int(len(hi) / (SLOTS * 0.9)), 1).bit_length()
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.insert(hi, lo):
                return made
            buckets *= 2

    @classmethod
    def read(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ int(mix(np.array([mark], _U))[0] & _U(len(self.slots) - 1))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Whether all keys found a place; if not, the filter is to be made anew with more buckets."""
        for mark, one, two in zip(*(x.tolist() for x in places(hi, lo, len(self.slots) - 1)), strict=True):
            bucket = one if (self.slots[one] == 0).any() else two
            for kick in range(KICKS):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = mark
                    break
                turned = (mark + kick) % SLOTS
                mark, self.slots[bucket, turned] = int(self.slots[bucket, turned]), mark
                bucket = self._other(bucket, mark)
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes out keys that are in the filter."""
        for mark, one, two in zip(*(x.tolist() for x in places(hi, lo, len(self.slots) - 1)), strict=True):
            bucket = one if (self.slots[one] == mark).any() else two
            self.slots[bucket, np.flatnonzero(self.slots[bucket] == mark)[0]] = 0

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = places(hi, lo, len(self.slots) - 1)
        return ((self.slots[one.astype(np.int64)] == mark[:, None]) | (self.slots[two.astype(np.int64)] == mark[:, None])).any(axis=1)


def _shard(hi: np.ndarray, shards: int) -> np.ndarray:
    """The shard of keys, by their top bits; ``shards`` is a power of two."""
    return (hi >> _U(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hi), np.int64)


class Filters:
    """The filters of some shards, laid end to end, and the keys that they wrongly take for common."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes, bytes]]) -> None:
        self.shards = shards
        self.first, self.mask = np.full(shards, -1, np.int64), np.zeros(shards, _U)
        slots, at = [], 0
        for shard, raw, _ in rows:
            one = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS)
            self.first[shard], self.mask[shard] = at, len(one) - 1
            slots.append(one)
            at += len(one)
        self.slots = np.concatenate(slots) if slots else np.zeros((0, SLOTS), np.uint16)
        self.not_common = {raw[i : i + 16] for _, _, raw in rows for i in range(0, len(raw), 16)}

    def common(self, found: list[bytes]) -> list[bool]:
        """Which hashes (none empty) are of common keys."""
        hi, lo = _halves(found)
        shard = _shard(hi, self.shards)
        known = np.flatnonzero(self.first[shard] >= 0)
        mark, one, two = places(hi[known], lo[known], self.mask[shard[known]])
        first = self.first[shard[known]]
        hit = np.zeros(len(found), bool)
        hit[known] = ((self.slots[first + one.astype(np.int64)] == mark[:, None]) | (self.slots[first + two.astype(np.int64)] == mark[:, None])).any(axis=1)
        return [h and x not in self.not_common for h, x in zip(hit.tolist(), found, strict=True)]


@dataclass
class Index:
    """Counts (hi, lo, refs) and filters (shard, slots, not_common, lines) of a corpus, both in the shared folder."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    limit: int


_COUNT = "hi long, lo long, refs long"
_FILTER = "shard int, slots binary, not_common binary, lines long"


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def counts(docs: DataFrame) -> DataFrame:
    """(hi, lo, refs): in how many documents each key occurs."""

    def told(counter: Counter) -> pa.RecordBatch:
        hi, lo = _halves(counter)
        return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(list(counter.values()), pa.int64())], names=["hi", "lo", "refs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counter.update(set(hashes(_lines(text.as_py()))) - {b""})
                if len(counter) > HELD:
                    yield told(counter)
                    counter = Counter()
        yield told(counter)

    return docs.select("text").mapInArrow(count, _COUNT).groupBy("hi", "lo").agg(F.sum("refs").alias("refs"))


def _sharded(shards: int):  # noqa: ANN202  a column
    bits = shards.bit_length() - 1
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


def _updated(limit: int):  # noqa: ANN202
    """The filter of one shard from its counts (hi, lo, refs, was) and its filter before, if there was one."""

    def update(now: pa.Table, before: pa.Table) -> pa.Table:
        hi, lo = (np.frombuffer(now.column(c).to_numpy().astype(np.int64).tobytes(), _U) for c in ("hi", "lo"))
        refs, was = (now.column(c).to_numpy() for c in ("refs", "was"))
        common = refs >= limit
        held = None
        if before.num_rows:
            held = Cuckoo.read(before.column("slots")[0].as_py())
            out, new = ~common & (was >= limit), common & (was < limit)
            held.delete(hi[out], lo[out])
            held = held if held.insert(hi[new], lo[new]) else None
        held = held or Cuckoo.of(hi[common], lo[common])
        # of the keys that the corpus has now, those that the filter takes for common
        wrong = ~common & (refs > 0) & held.contains(hi, lo)
        raw = np.stack([hi[wrong], lo[wrong]], axis=1).astype(">u8").tobytes()
        shard = (now if now.num_rows else before).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([held.slots.tobytes()], pa.binary()), "not_common": pa.array([raw], pa.binary()), "lines": pa.array([int(refs.sum())], pa.int64())})

    return update


def _changed(index: Index | None, delta: DataFrame, limit: int) -> Index:
    spark = delta.sparkSession
    rows = delta.withColumn("was", F.lit(0).cast("long"))
    if index is not None:
        rows = rows.unionByName(index.refs.withColumn("was", F.col("refs")))
    merged = written(rows.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.sum("was").alias("was")), "merged")
    keys, least = merged.agg(F.count("*"), F.min("refs")).first()
    if (least or 0) < 0:
        removed(merged)
        raise ValueError("documents to delete that were never inserted")
    shards = 1 << max(-(-keys // KEYS) - 1, 0).bit_length()
    old = spark.createDataFrame([], _FILTER)
    if index is not None and index.shards <= shards < 4 * index.shards:
        shards, old = index.shards, index.filters
    by = merged.withColumn("shard", _sharded(shards))
    filters = written(by.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_updated(limit), _FILTER), "filters")
    refs = written(merged.where("refs > 0").select("hi", "lo", "refs"), "refs")
    removed(merged)
    return Index(refs, filters, shards, limit)


def build(docs: DataFrame, limit: int = LIMIT) -> Index:
    """The index of a corpus."""
    return _changed(None, counts(docs), limit)


def inserted(index: Index, docs: DataFrame) -> Index:
    """The index with more documents. The one before stays as it is."""
    return _changed(index, counts(docs), index.limit)


def deleted(index: Index, docs: DataFrame) -> Index:
    """The index without these documents, which it must have. The one before stays as it is."""
    return _changed(index, counts(docs).withColumn("refs", -F.col("refs")), index.limit)


RESULT = "doc_id long, n_lines long, n_dropped long, kept string"


def _kept(rows: list[tuple[int | None, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    arrays = [pa.array(c, pa.int64()) for c in columns[:3]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def _without(doc_id: int | None, lines: list[bytes], keys: list[bytes], common: set[bytes]) -> tuple[int | None, int, int, bytes]:
    stay = [x for x, k in zip(lines, keys, strict=True) if k not in common]
    return doc_id, len(lines), len(lines) - len(stay), b"\n".join(stay)


def _everywhere(docs: DataFrame, index: Index) -> DataFrame:
    rows = [(r.shard, bytes(r.slots), bytes(r.not_common)) for r in index.filters.select("shard", "slots", "not_common").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Filters(index.shards, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lines = [_lines(t.as_py()) for t in batch.column(1)]
            keys = [hashes(own) for own in lines]
            known = list({k for own in keys for k in own if k})
            common = {k for k, c in zip(known, shared.value.common(known), strict=True) if c}
            yield _kept([_without(*x, common) for x in zip(ids, lines, keys, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def _name(doc_id: int | None, text: str | None) -> bytes:
    """A row's name: equal rows have one name and one fate."""
    return xxhash.xxh3_128_digest(f"{doc_id}:{'-' if text is None else '+'}{text or ''}".encode())


def _by_shards(docs: DataFrame, index: Index) -> DataFrame:
    limit, shards = index.limit, index.shards
    assert limit > 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = list(set(hashes(_lines(text))) - {b""})
                hi, _ = _halves(own)
                yield pa.RecordBatch.from_arrays([pa.array([_name(doc_id, text)] * len(own), pa.binary()), pa.array(own, pa.binary()), pa.array(_shard(hi, shards), pa.int32())], names=["row", "key", "shard"])

    def ask(own: pa.Table, held: pa.Table) -> pa.Table:
        if not (own.num_rows and held.num_rows):
            return own.select(["row", "key"]).slice(0, 0)
        one = Filters(shards, [(held.column("shard")[0].as_py(), held.column("slots")[0].as_py(), held.column("not_common")[0].as_py())])
        return own.select(["row", "key"]).filter(pa.array(one.common(own.column("key").to_pylist())))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_name(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=["doc_id", "text", "row"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = _lines(text)
                out.append(_without(doc_id, lines, hashes(lines), set(common or ())))
            yield _kept(out)

    parts = written(index.filters.select("shard", (F.floor(F.col("lines") / PART) + 1).alias("parts")), "parts")
    asked = docs.mapInArrow(pairs, "row binary, key binary, shard int").join(small(parts, 16), "shard")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), "parts")).select("row", "key", "shard", "part")
    dealt = index.filters.join(small(parts, 16), "shard").select("shard", "slots", "not_common", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    found = asked.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(ask, "row binary, key binary")
    by_row = found.groupBy(F.col("row").alias("c_row")).agg(F.collect_set("key").alias("common"))
    told = docs.mapInArrow(named, "doc_id long, text string, row binary").join(by_row, F.col("row") == F.col("c_row"), "left")
    return told.select("doc_id", "text", "common").mapInArrow(drop, RESULT)


def without_common_lines(docs: DataFrame, index: Index, most: int = BROADCAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row; ``docs`` are documents of the index. Filters of more than ``most`` bytes
    stay where they are and the lines come to them."""
    held = index.filters.agg(F.sum(F.length("slots") + 8 * F.length("not_common"))).first()[0] or 0
    return _everywhere(docs, index) if held <= most else _by_shards(docs, index)


def op13_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_common_lines(docs, build(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH told AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM told),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT id) >= 10),
marked AS (SELECT id, line, place, key IN (SELECT key FROM common) AS gone FROM keyed),
kept AS (SELECT id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM marked GROUP BY id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept JOIN told USING (id)
"""
