"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its 5-word shingles, each weighted by its number of occurrences. For every term and
every sample k there are r ~ Gamma(2, 1), c ~ Gamma(2, 1) and beta ~ U(0, 1), the same in every document; with
t = floor(ln(w) / r + beta), the sample takes the term with the least ln a = ln c - r * (t - beta) - r. The pair
(term, t) it takes is equal in two documents with a probability of their generalised Jaccard similarity, the sum of
the lesser weights over the sum of the greater ones.

The gamma triples come from a seeded pool of 65,536, chosen by the upper 16 bits of a hash of (term, k); of equal values the
least hash wins, so the choice stays consistent. Each sample leaves 16 bits in the fingerprint. A fingerprint needs its
document alone; the query, which compares each document with the next by doc_id, shuffles texts once, by blocks of doc_id.

Defined results: null is an empty text; texts without words share one fingerprint and are alike to 1.0 with each
other, to 0.0 with texts that have words; equal texts have equal fingerprints; a very long text takes memory in
proportion to its words, in one task; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.llm import words
from quillspark.llm.tables import partitions, table

SAMPLES, SHINGLE, SEED = 64, 5, 20240501
_U32 = np.uint32
_EMPTY = np.full(SAMPLES, 0xFFFF, np.uint16)
# Bytes of text that are fingerprinted together.
_HELD = 1 << 19


class _Pool:
    """The gamma triples, in order of the value that a term of weight 1 draws; made once in each Python process.

    So for weight 1 the triple's number orders as the value itself does, and needs no looking up."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        r, ln_c, beta = rng.gamma(2.0, 1.0, 1 << 16), np.log(rng.gamma(2.0, 1.0, 1 << 16)), rng.random(1 << 16)
        ones = ln_c + r * beta - r
        order = np.argsort(ones)
        self.r, self.ln_c, self.beta, self.ones = r[order], ln_c[order], beta[order], ones[order]
        self.lo = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(_U32) | _U32(1)
        self.hi = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(_U32) | _U32(1)

    def weighted(self, keys: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
        """The keys of terms of weight w: the place of their value among those of weight 1, then bits of (term, t)."""
        i = keys >> _U32(16)
        r, beta = self.r[i], self.beta[i]
        t = np.floor(ln_w / r + beta)
        place = np.minimum(np.searchsorted(self.ones, self.ln_c[i] - r * (t - beta) - r), 0xFFFF).astype(_U32)
        return (place << _U32(16)) | ((keys + t.astype(_U32) * _U32(1021)) & _U32(0xFFFF))


_made: list[_Pool] = []


def _pool() -> _Pool:
    if not _made:
        _made.append(_Pool())
    return _made[0]


def sketch(column: pa.Array) -> np.ndarray:
    """A row of SAMPLES 16-bit values for each text of a string column."""
    pool, out = _pool(), np.empty((len(column), SAMPLES), np.uint16)
    for row, data, offsets in words.blocks(column):
        terms, at = words.shingle_hashes(*words.word_hashes(data, offsets), SHINGLE)
        n = len(offsets) - 1
        made = np.diff(at)
        part = out[row : row + n]
        part[:] = _EMPTY
        if not len(terms):
            continue
        # the terms that occur more than once in their text, with their weights
        owner = np.repeat(np.arange(n, dtype=np.uint64), made)
        own = words.mix(terms + owner * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        weights = None
        if len(twice):
            again = np.flatnonzero(np.isin(own, np.unique(twice)))
            _, back, number = np.unique(own[again], return_inverse=True, return_counts=True)
            weights = np.log(number[back])
        lo, hi = terms.astype(_U32), (terms >> np.uint64(32)).astype(_U32)
        full = np.flatnonzero(made)
        begins = at[:-1][full]
        for k in range(SAMPLES):
            keys = lo * pool.lo[k] + hi * pool.hi[k]
            if weights is not None:
                keys[again] = pool.weighted(keys[again], weights)
            least = np.minimum.reduceat(keys, begins)
            part[full, k] = np.minimum((least * _U32(0x9E3779B1)) >> _U32(16), 0xFFFE)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def as_text(sketches: np.ndarray) -> list[str]:
    raw, width = sketches.astype(">u2").tobytes().hex(), SAMPLES * 4
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of fingerprints: 4 hexadecimal digits a sample. Other columns stay as they are."""
    schema = StructType([*docs.drop(name).schema, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(as_text(sketch(batch.column(batch.schema.get_field_index(text)))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.drop(name).mapInArrow(run, schema)


def _block_ends(docs: DataFrame, blocks: int) -> list[int]:
    """The greatest doc_id of each of about ``blocks`` blocks of like size, in order. Percentiles are ids that occur."""
    found = docs.select(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks + 1)], 20 * blocks)).first()[0]
    return sorted(set(found or []))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next document.

    The order is descending doc_id (null last; of equal ones by text), and the first document follows the last. One
    shuffle deals the texts out by blocks of doc_id; each block also gets the row that follows its last one, so nothing
    is ordered in one task. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ends = _block_ends(docs, 4 * partitions(spark))
    # null ids belong to the lowest block
    key = F.coalesce("doc_id", F.lit(ends[0] - 1 if ends else 0))
    held = np.array(ends or [0])

    @F.pandas_udf("array<struct<to int, end int>>")
    def places(ids: pd.Series) -> pd.Series:
        block = np.searchsorted(held, ids.to_numpy())
        # the first row of a block also ends the block before it (the highest block's ends the lowest)
        first = held[block] == ids.to_numpy()
        return pd.Series([[{"to": b, "end": 0}, {"to": (b + 1) % len(held), "end": 1}] if f else [{"to": b, "end": 0}] for b, f in zip(block.tolist(), first.tolist(), strict=True)])

    sent = docs.select("doc_id", "text", F.inline(places(key)))
    dealt = sent.repartition(partitions(spark), "to").sortWithinPartitions("to", "end", F.desc_nulls_last("doc_id"), "text")
    return dealt.select("to", "end", "doc_id", "text").mapInArrow(_edit, RESULT)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def out(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: those of one block and the row after them; results for all but the last."""
        texts = [x[1] for x in rows]
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            m = len(text) // 3
            edited.append(text[: len(text) - m] + after[:m])
        plain, changed = sketch(pa.array(texts, pa.large_string())), sketch(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in rows[:-1]], pa.int64()),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edited], pa.string()),
                pa.array(as_text(plain[:-1]), pa.string()),
                pa.array(as_text(changed), pa.string()),
                pa.array(likeness(plain[:-1], changed), pa.float64()),
                pa.array(likeness(plain[:-1], plain[1:]), pa.float64()),
            ],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )

    block, closed = None, False
    for batch in batches:
        for to, end, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if to != block:
                block, closed, held, size = to, False, [], 0
            if closed:
                continue  # of equal doc_ids at a block's start, the first row alone follows the block before
            held.append((doc_id, text))
            size += len(text)
            closed = end == 1
            if len(held) > 1 and (closed or size > _HELD):
                yield out(held)
                held, size = held[-1:], len(text)


def op1_consistent_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
