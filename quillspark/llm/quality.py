"""Quality by ordinal cumulative-link regression on graded ratings.

A rated document has grade 0 (poor), 1 (sound but toxic) or 2 (sound). The model is P(grade <= k) = s(threshold[k] - x.w)
with s the logistic function: one set of weights, shared by all grades, on hashes of the text's runs of letters (whole and
their first bytes) and of punctuation, and of a few rounded shares (repeated words and lines, capitals, punctuation, rules), and thresholds in
order. It gives each text its expected grade, and the tail probability P(grade >= 2) by which documents are selected.

Learning reads a bounded sample of the ratings: those of about ``SAMPLE`` documents, chosen by a hash of doc_id. They are
written with their texts once, in the shared folder. Spark counts on that sample in how many texts of each grade a hash
occurs; the hashes whose grades differ most from the others' are the features, ``FEATURES`` at most. Scoring covers every
text, whole, in one pass without a shuffle.

Defined results: a null text is an empty one; without ratings, with ratings of one grade, or where no feature tells the
grades apart, all documents are kept with the prior's expected grade; equal texts score alike; other columns stay (but for those
named like the three results, which are replaced);
ratings of unknown documents do not count; a null quality counts as 0, a null toxic as 0; a document rated with several
grades counts once with each, equal ratings count once, and of several texts under one doc_id the least one counts, so
that repeated rows cannot swell the sample; a very long text takes memory in proportion to itself, in one task; an empty
table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from quillspark.llm import words
from quillspark.llm.tables import table, written

SAMPLE, FEATURES, LEAST_TEXTS, LEAST_Z, KEEP_AT, GRADES = 20_000, 2_000, 5, 5.0, 0.8, 3
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SMALL = np.zeros(256, bool)
_SMALL[48:58] = _SMALL[97:123] = _SMALL[128:] = True
_KIND = np.where(words.SPACE, 0, np.where(_LETTER, 1, 2)).astype(np.int8)
_SHARES, _STEMS = 6, (4, 5)


def _duplicates(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's hashes repeat an earlier one."""
    own = np.sort(words.mix(hashes + owner.astype(_U) * _U(0x9E3779B97F4A7C15)))
    distinct = np.unique(own)
    if len(distinct) == len(own):
        return np.zeros(n, np.int64)
    # count distinct ones by text
    _, first = np.unique(words.mix(hashes + owner.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash), not distinct, for the texts of a block of UTF-8 bytes."""
    n, size = len(offsets) - 1, len(data)
    kind = _KIND[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    begins = np.ones(size, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= edge[:-1]
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], size)
    kinds = kind[at]
    sums = np.zeros(size + 1, _U)
    np.cumsum(words._FOLDED[data] * words._powers(size, words._BASE), out=sums[1:])
    inverse = words._powers(size + 1, words._INVERSE)
    hashed = lambda a, b: words.mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
    some = kinds > 0
    start, end, kinds = at[some], ends[some], kinds[some]
    runs = hashed(start, end)
    owner = np.searchsorted(offsets, start, "right") - 1
    letters = kinds == 1
    number = np.maximum(np.bincount(owner[letters], minlength=n), 1)
    w_hash, w_owner, w_start, w_end = runs[letters], owner[letters], start[letters], end[letters]
    small = np.concatenate([[0], np.cumsum(_SMALL[data])])
    capital = (small[w_end] == small[w_start]) & (w_end - w_start > 1)
    again = np.zeros(len(w_hash), bool)
    again[1:] = (w_hash[1:] == w_hash[:-1]) & (w_owner[1:] == w_owner[:-1])
    marks = ~letters & (end - start > 1)
    line_at = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    line_at = line_at[line_at < size]
    line_owner = np.searchsorted(offsets, line_at, "right") - 1
    lines = hashed(line_at, np.append(line_at[1:], size)) if len(line_at) else np.zeros(0, _U)
    line_number = np.maximum(np.bincount(line_owner, minlength=n), 1)
    bars = np.searchsorted(offsets, np.flatnonzero(data == 124), "right") - 1
    shares = [
        np.bincount(w_owner[capital], minlength=n) / number,
        np.bincount(w_owner[again], minlength=n) / number,
        np.bincount(owner[marks], minlength=n) / number,
        np.bincount(bars, minlength=n) / number,
        _duplicates(line_owner, lines, n) / line_number,
        np.log2(number) / 16,
    ]
    rounded = [words.mix(np.full(n, (j + 1) << 8, _U) + np.ceil(np.minimum(s, 1.0) * 8).astype(_U)) for j, s in enumerate(shares)]
    # the beginnings of longer words stand for their inflections
    stems = [(long := np.flatnonzero(w_end - w_start >= k), words.mix(hashed(w_start[long], w_start[long] + k) + _U(k))) for k in _STEMS]
    return np.concatenate([owner, *[w_owner[x] for x, _ in stems], *[np.arange(n)] * _SHARES]), np.concatenate([runs, *[h for _, h in stems], *rounded])


@dataclass
class Model:
    """Feature hashes in order, their weights, and the thresholds between grades."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def found(self, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number) among those given."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.zeros(1 << 16, bool)
        first[(self.hashes >> _U(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(first[(hashes >> _U(48)).astype(np.int64)])
        h = hashes[maybe]
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[place] == h
        pairs = np.unique(owner[maybe[hit]].astype(np.int64) * len(self.hashes) + place[hit])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def latent(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for row, data, offsets in words.blocks(column):
            own, place = self.found(*features(data, offsets))
            out[row : row + len(offsets) - 1] = np.bincount(own, self.weights[place], minlength=len(offsets) - 1)
        return out

    def at_most(self, latent: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each threshold k, a row a text."""
        return 1.0 / (1.0 + np.exp(np.clip(latent[:, None] - self.thresholds[None], -60, 60)))


def fit(owner: np.ndarray, place: np.ndarray, grades: np.ndarray, width: int, penalty: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the penalised likelihood of the cumulative-link model."""
    n = len(grades)
    shares = np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n
    raw = np.log((shares * n + 0.5) / (n - shares * n + 0.5))
    # thresholds in order: the first, and logs of the distances
    x = np.concatenate([np.zeros(width), raw[:1], np.log(np.maximum(np.diff(raw), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, t0, gaps = x[:width], x[width], np.exp(np.minimum(x[width + 1 :], 10))
        thresholds = np.concatenate([[-np.inf], t0 + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = np.bincount(owner, w[place], minlength=n)
        s = lambda t: 1.0 / (1.0 + np.exp(-np.clip(t, -40, 40)))
        upper, lower = s(thresholds[grades + 1] - z), s(thresholds[grades] - z)
        upper[grades == GRADES - 1], lower[grades == 0] = 1.0, 0.0
        du, dl = upper * (1 - upper), lower * (1 - lower)
        p = np.maximum(upper - lower, 1e-9)
        gz = -(du - dl) / p  # of the log likelihood by z
        gt = np.zeros(GRADES + 1)
        np.add.at(gt, grades + 1, du / p)
        np.add.at(gt, grades, -dl / p)
        inner = gt[1:-1]
        gradient = np.concatenate([np.bincount(place, gz[owner], minlength=width) - penalty * w, [inner.sum()], [inner[i + 1 :].sum() * gaps[i] for i in range(len(gaps))]]) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x = x + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * min(1.0, 4 * (1 - step / (steps + 1)))
    gaps = np.exp(np.minimum(x[width + 1 :], 10))
    return x[:width], x[width] + np.concatenate([[0], np.cumsum(gaps)])


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(F.coalesce(quality, F.lit(0)) <= 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, seed: int = 11) -> Model:
    """A model from at most about ``sample`` ratings (doc_id, quality, toxic)."""
    rated = labels.where("doc_id IS NOT NULL").select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).distinct()
    total = rated.select("doc_id").distinct().count()
    share = min(1.0, sample / max(total, 1))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    # the sample's size is bounded, so it may be sent to every task
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = written(texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade"), "sample")

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in words.blocks(batch.column(0)):
                own, hashes = features(data, offsets)
                _, first = np.unique(words.mix(hashes + own.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)
                # distinct in each text; then counted for the block
                key, inverse = np.unique(hashes[first], return_inverse=True)
                counts = np.bincount(inverse * GRADES + grades[row + own[first]], minlength=len(key) * GRADES).reshape(-1, GRADES)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(c) for c in counts.T.astype(np.int64))], names=["h", "n0", "n1", "n2"])

    n = {r["grade"]: r["n"] for r in texts.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    sizes = [n.get(k, 0) for k in range(GRADES)]
    if sum(1 for x in sizes if x) < 2:
        only = next((k for k, x in enumerate(sizes) if x), GRADES - 1)
        return Model(np.zeros(0, _U), np.zeros(0), np.where(np.arange(GRADES - 1) < only, -40.0, 40.0))
    counted = texts.mapInArrow(occurring, "h long, n0 long, n1 long, n2 long").groupBy("h").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(GRADES)])
    everything, all_n = F.col("n0") + F.col("n1") + F.col("n2"), float(sum(sizes))
    z = F.greatest(
        *[
            F.abs(F.col(f"n{k}") - everything * (sizes[k] / all_n)) / F.sqrt(everything * (sizes[k] / all_n) * (1 - sizes[k] / all_n) * (1 - everything / (all_n + 1)) + 1e-9)
            for k in range(GRADES)
            if 0 < sizes[k] < all_n
        ]
    )
    strong = counted.where(everything >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(most).select("h").collect()
    if not strong:
        raw = np.cumsum(sizes)[:-1] / all_n
        return Model(np.zeros(0, _U), np.zeros(0), np.log((raw * all_n + 0.5) / (all_n - raw * all_n + 0.5)))
    hashes = np.sort(np.array([r["h"] for r in strong], np.int64).view(_U))
    model = Model(hashes, np.zeros(len(hashes)), np.zeros(GRADES - 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = batch.column(1)
            for row, data, offsets in words.blocks(batch.column(0)):
                own, place = model.found(*features(data, offsets))
                edges = np.searchsorted(own, np.arange(len(offsets)))
                place = place.astype(np.int32)
                grade_of = grades.slice(row, len(offsets) - 1).cast(pa.int32())
                keys = [int.from_bytes(hashlib.blake2b(place[a:b].tobytes() + bytes([g]), digest_size=8).digest(), "little", signed=True) for a, b, g in zip(edges[:-1], edges[1:], grade_of.to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(place))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, grade_of], names=["key", "places", "grade"])

    # the bounded sample's rows, as numbers of features in plain arrays; the order by key is the same on every run
    sampled = texts.mapInArrow(rows, "key long, places array<int>, grade int").toArrow().sort_by("key").combine_chunks()
    lists = sampled.column("places").combine_chunks()
    place = lists.flatten().to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    weights, thresholds = fit(own, place, sampled.column("grade").to_numpy(), len(hashes))
    return Model(hashes, weights, thresholds)


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and keep; columns of these names that ``docs`` has are replaced."""
    docs = docs.drop("expected_grade", "tail_probability", "keep")
    schema = StructType([*docs.schema, StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType()), StructField("keep", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = model.at_most(model.latent(batch.column(batch.schema.get_field_index("text"))))
            tail = 1.0 - below[:, -1]
            keep = tail >= keep_at if len(model.hashes) else np.ones(len(tail), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((1.0 - below).sum(axis=1)), pa.array(tail), pa.array(keep)], [*batch.schema.names, "expected_grade", "tail_probability", "keep"])

    return docs.mapInArrow(run, schema)


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels"))).drop("text")
