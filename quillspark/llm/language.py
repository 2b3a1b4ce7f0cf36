"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, seeded by the letter alone. A trigram binds its letters' vectors, each
rolled by its place, with elementwise products. A text bundles (adds) its trigrams' vectors, and so does a language over
all its learning texts; a document gets the language whose prototype has the largest cosine.

Trigrams run over lower-cased letters, with one blank for each run of anything else. A task counts trigrams before it
binds vectors, so that equal trigrams are bound once, and a language's prototype is summed up from one row a task and
language. Prototypes are centred: what all languages share is taken off each by its weight, so that common trigrams
do not decide. Nothing is shuffled but those sums.

Defined results: ``und`` with score 0.0 for a null text or one without a letter, or where nothing was learned; equal
texts, long or short, get equal results; a very long text is looked at in pieces that see one character over their
edges, and trigrams are bound some thousand at a time, so memory does not grow with a text's trigrams; an empty table
gives an empty result; other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.llm.tables import table

DIMENSIONS, NONE, SEED = 512, "und", 77
#: Characters that a task looks at together, trigram vectors that it binds at once, and texts whose bundles it holds.
BLOCK, TRIGRAMS, ROWS = 1 << 17, 1 << 13, 1 << 11


class _Letters:
    """Numbers of code points (0: not a letter) and their vectors; vectors are made when first met."""

    def __init__(self) -> None:
        self.number = np.zeros(0x110000, np.int32)
        self.seen = np.zeros(0x110000, bool)
        self.seen[[0x20, 0x0A]] = True
        self.vectors = self._vector(0)[None]

    def _vector(self, code: int) -> np.ndarray:
        return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        if not self.seen[codes].all():
            new = np.unique(codes[~self.seen[codes]])
            letters = [c for c in new.tolist() if chr(c).isalpha()]
            self.seen[new] = True
            self.number[letters] = np.arange(len(self.vectors), len(self.vectors) + len(letters))
            if letters:
                self.vectors = np.concatenate([self.vectors, [self._vector(c) for c in letters]])
        return self.number[codes]

    def bind(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, given as three numbers of 21 bits."""
        a, b, c = (self.vectors[(keys >> s) & 0x1FFFFF] for s in (42, 21, 0))
        return (np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c).astype(np.float32)


_made: list[_Letters] = []


def _letters() -> _Letters:
    if not _made:
        _made.append(_Letters())
    return _made[0]


def _portions(texts: list[str]) -> Iterator[list[tuple[int, str, int, int]]]:
    """Lower-cased pieces (text number, piece, characters of context before, after), about ``BLOCK`` characters at a time.

    A longer text is cut into pieces that see one character over their edges."""
    part: list[tuple[int, str, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        for at in range(0, len(lowered), BLOCK):
            end = min(at + BLOCK, len(lowered))
            part.append((i, lowered[max(at - 1, 0) : end + 1], int(at > 0), int(end < len(lowered))))
            size += end - at
            if size >= BLOCK:
                yield part
                part, size = [], 0
    if part:
        yield part


def trigrams(pieces: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, trigram) of every trigram with a letter in its midst."""
    # two breaks between pieces, so that no trigram joins two of them
    codes = np.frombuffer("\n\n".join(["", *(p[1] for p in pieces), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = _letters().numbers(codes).astype(np.int64)
    lengths = np.array([len(p[1]) for p in pieces])
    ends = np.cumsum(lengths + 2)
    own = np.ones(len(n), bool)
    for side, at in ((2, ends - lengths), (3, ends - 1)):
        own[at[[p[side] > 0 for p in pieces]]] = False
    middle = np.flatnonzero((n[1:-1] > 0) & own[1:-1]) + 1
    keys = (n[middle - 1] << 42) | (n[middle] << 21) | n[middle + 1]
    return np.array([p[0] for p in pieces])[np.searchsorted(ends, middle - 2, "right")], keys


def bundles(texts: list[str], of: np.ndarray, groups: int) -> np.ndarray:
    """The summed trigram vectors of each group of texts (``of``: a text's group). Only ``TRIGRAMS`` vectors are bound at once."""
    out = np.zeros((groups, DIMENSIONS))
    for part in _portions(texts):
        own, keys = trigrams(part)
        if not len(keys):
            continue
        found, back = np.unique(keys, return_inverse=True)
        here, place = np.unique(of[own], return_inverse=True)
        for first in range(0, len(found), TRIGRAMS):
            vectors = _letters().bind(found[first : first + TRIGRAMS])
            width = max(1, (1 << 19) // len(vectors))
            inside = slice(None) if len(found) <= TRIGRAMS else (back >= first) & (back < first + len(vectors))
            row, column = place[inside], back[inside] - first
            if len(here) > width:
                order = np.argsort(row, kind="stable")
                row, column = row[order], column[order]
            for i in range(0, len(here), width):
                rows = min(width, len(here) - i)
                span = slice(*np.searchsorted(row, [i, i + rows])) if len(here) > width else slice(None)
                counts = np.bincount((row[span] - i) * len(vectors) + column[span], minlength=rows * len(vectors))
                out[here[i : i + rows]] += counts.reshape(rows, -1).astype(np.float32) @ vectors
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document's language is kept from learning; a null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language from all rows of (text, lang) with a lang; a vector a language comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            summed = bundles(batch.column(0).to_pylist(), langs.indices.to_numpy(), len(names))
            for name, v in zip(names, summed, strict=True):
                sums[name] = sums.get(name, 0.0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    partial = docs.where(F.col("lang").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(run, "lang string, v array<double>")
    # added up dimension by dimension, with sums of whole numbers, so that the order of tasks does not matter
    summed = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.col("x").cast("decimal(30,0)")).cast("double").alias("x"))
    listed = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sorted(listed, key=lambda r: r["lang"])}


def centred(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, less what they all share."""
    names = list(prototypes)
    unit = np.array([v / (np.linalg.norm(v) or 1.0) for v in prototypes.values()])
    if len(names) > 1:
        shared = unit.mean(axis=0)
        unit = unit - np.outer(unit @ shared / (shared @ shared or 1.0), shared)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return names, unit.astype(np.float32)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score: (1 + cosine) / 2 of the language that is nearest."""
    docs = docs.drop("lang_pred", "score")
    names, unit = centred(prototypes) if prototypes else ([], np.zeros((0, DIMENSIONS), np.float32))
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores = [NONE] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts) if names else 0, ROWS):
                bundle = bundles(own := texts[at : at + ROWS], np.arange(len(own)), len(own))
                cosines = (bundle @ unit.T) / np.maximum(np.linalg.norm(bundle, axis=1), 1e-12)[:, None]
                best = cosines.argmax(axis=1)
                for j in np.flatnonzero(bundle.any(axis=1)).tolist():
                    langs[at + j] = names[best[j]]
                    scores[at + j] = min(1.0, max(0.0, (1.0 + float(cosines[j, best[j]])) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(asked, prototypes).drop("text")
