"""Periodic runs of words by an online, sparse diagonal recurrence.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``max(LEAST, TIMES * q)`` that no neighbouring word extends keeping the period. A word that equals the one d before it
lies on the diagonal of lag d; the recurrence is length[i, d] = length[i - 1, d] + 1 where they are equal, else 0, and a
diagonal that ends with d + length long enough gives a run at once.

Following all earlier occurrences of a word takes time quadratic in a frequent word. The recurrence is kept sparse,
without losing a run: lags are taken in classes (g/2, g], g a power of two. In a class a word goes with the g - 1 words
before it, and only its latest earlier occurrence in that company counts. In a run of period q <= g any shorter lag would,
by the theorem of Fine and Wilf, give the run a shorter period, so the latest occurrence is exactly q back, from the
first word whose company fits to the last word of the run. So each class has at most one active lag a word, and words whose
company occurs once leave all larger classes. Time is n log n, memory in proportion to one block of texts (a longer text
is a block of its own, in one task). Companies are ranks of pairs of ranks, so words are compared exactly, not by hashes.

Each document is worked on alone, without a shuffle; a hot source or copies do not matter.

Defined results: a null, empty or wordless text has no runs and an empty collapsed text; equal texts give equal results;
repeated rows give repeated rows; null doc_ids pass through; other columns are not read, whatever their names; an empty
table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.tables import table

LEAST, TIMES = 6, 4
#: Words of the texts that are worked on at once, but for a single longer text.
BLOCK = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def maximal_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of each run, by text, start, period.

    ``ids`` are the words of all texts as numbers, ``first`` the index of each text's first word and their end; starts count
    from the text's first word. ``times`` is at least 4, which the classes of lags rely on."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(size[owner] >= max(least, times))
    key = owner[at] * (int(ids.max(initial=0)) + 1) + ids[at]
    found, g = [np.zeros((4, 0), np.int64)], 1
    while len(at):
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        earlier, later = order[:-1][again], order[1:][again]
        lag = np.zeros(len(at), np.int64)
        lag[later] = at[later] - at[earlier]
        active = np.flatnonzero((lag > g // 2) & (lag <= g))
        if len(active):
            i, d = at[active], lag[active]
            begins = np.append(True, (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1]))
            ends = np.append(begins[1:], True)
            d, start = d[begins], i[begins] - g + 1 - d[begins]
            length = i[ends] + 1 - start
            enough = length >= np.maximum(least, times * d)
            text = owner[i[begins]]
            found.append(np.stack([text, start - first[text], length, d])[:, enough])
        # the next class: words whose company, and the company g before it, occur again
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(np.append(0, ~again)[: len(at)])
        repeated = np.zeros(len(at), bool)
        repeated[earlier] = repeated[later] = True
        where, own = at[repeated], rank[repeated]
        back = np.searchsorted(where, where - g)
        fits = (where[np.minimum(back, len(where) - 1)] == where - g) & (size[owner[where]] >= times * (g + 1))
        fits &= owner[np.maximum(where - g, 0)] == owner[where]
        at, key = where[fits], own[back[fits]] * len(rank) + own[fits]
        g *= 2
    text, start, length, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _results(rows: list[tuple], words: list[bytes], first: list[int]) -> pa.RecordBatch:
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text, start, length, period = maximal_runs(ids, np.array(first))
    # a word is dropped if a run holds it after its first period
    steps = np.zeros(len(words) + 1, np.int64)
    begins = np.array(first)[text] + start
    np.add.at(steps, begins + period, 1)
    np.add.at(steps, begins + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    ends = np.searchsorted(text, np.arange(len(rows) + 1))
    collapsed = [b" ".join(words[a:b] if ends[k] == ends[k + 1] else compress(words[a:b], kept[a:b])) for k, (a, b) in enumerate(zip(first, first[1:], strict=False))]
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int | None] = []
        words: list[bytes] = []
        first = [0]
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            # without an argument, bytes are split at 0x20 and 0x09-0x0D
            words += text.as_py().encode().split()
            rows.append(doc_id.as_py())
            first.append(len(words))
            if len(words) >= BLOCK:
                yield _results(rows, words, first)
                rows, words, first = [], [], [0]
        if rows:
            yield _results(rows, words, first)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs by start, then period, and its text with each run cut to
    its first period, words joined by one blank."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_find, RESULT)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first."""
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, nothing, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The documents of the query: of those with crc32(doc_id) divisible by 10, a tail is made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = docs.withColumn("g", F.when(h % 10 == 0, g)).withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))))
    n = F.size("words").cast("long")
    placed = chosen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.element_at("words", (F.col("a") + i % F.col("p") + 1).cast("int")))
    edited = F.array_join(F.concat(F.slice("words", 1, F.col("a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        exponent.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
