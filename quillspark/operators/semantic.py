"""Vector search over embedded chunks: exact scan, nearest chunk a page, top pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import vectors
from quillspark.operators import graph

CHUNK = 6000


def pack_paragraphs(body: str, limit: int = CHUNK) -> list[str]:
    """Paragraphs packed in order into pieces of at most ``limit`` code points; longer ones are cut. At least one piece."""
    pieces: list[str] = []
    current = ""
    for paragraph in (p.strip() for p in body.split("\n\n")):
        if not paragraph:
            continue
        if current and len(current) + 2 + len(paragraph) <= limit:
            current = f"{current}\n\n{paragraph}"
            continue
        if current:
            pieces.append(current)
        while len(paragraph) > limit:
            pieces.append(paragraph[:limit])
            paragraph = paragraph[limit:]
        current = paragraph
    if current or not pieces:
        pieces.append(current)
    return pieces


def chunks(pages: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(uri, chunk, content) of pages (uri, body)."""

    @F.pandas_udf("array<string>")
    def split(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: pack_paragraphs(b or "", limit))

    return pages.select("uri", F.posexplode(split("body")).alias("chunk", "content"))


def embed(chunked: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Chunks with an embedding column, from any function of a list of texts."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in chunked.dtypes)}, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made: list[list[float]] = []
            texts = frame["content"].tolist()
            for i in range(0, len(texts), batch):
                part = embedder(texts[i : i + batch])
                if len(part) != len(texts[i : i + batch]):
                    raise ValueError("the embedder returned another number of vectors than texts")
                made += part
            yield frame.assign(embedding=made)

    return chunked.mapInPandas(run, schema)


def hash_embedder(dimensions: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder: signed counts of hashed words, of unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in text.lower().split() or [""]:
                h = zlib.crc32(word.encode())
                v[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else [1.0] + [0.0] * (dimensions - 1))
        return out

    return run


def check_meta(meta: dict | None, model: str, fingerprint: str, dimensions: int) -> None:
    """Raises unless the index exists and was built with this model, these pages and this size."""
    if meta is None:
        raise ValueError("no index for this scope")
    for name, want in (("model", model), ("fingerprint", fingerprint), ("dimensions", dimensions)):
        if meta[name] != want:
            raise ValueError(f"the index has another {name}: {meta[name]!r}, not {want!r}")


def nearest(chunked: DataFrame, query: list[float] | Column, limit: int) -> DataFrame:
    """(uri, chunk, similarity): each page's nearest chunk, the best pages first. An exact scan; one row a page is shuffled."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    near = chunked.select("uri", "chunk", vectors.cosine(F.col("embedding"), q).alias("similarity")).where("similarity IS NOT NULL")
    best = near.groupBy("uri").agg(F.max_by(F.struct("chunk", "similarity"), F.struct("similarity", -F.col("chunk"))).alias("x"))
    return best.select("uri", "x.chunk", "x.similarity").orderBy(F.desc("similarity"), "uri").limit(limit)


def query(chunked: DataFrame, meta: dict | None, question: str, embedder: Callable[[list[str]], list[list[float]]], trust: DataFrame, model: str, fingerprint: str, dimensions: int, limit: int) -> DataFrame:
    """The nearest pages to a question, best first, with their live trust facts (uri, ...); a page that is gone falls out.

    The index is checked before the question is embedded; the question's vector must be valid and of the index's size."""
    check_meta(meta, model, fingerprint, dimensions)
    found = embedder([question])
    if len(found) != 1 or len(found[0]) != dimensions or not any(found[0]):
        raise ValueError("the embedder returned no valid vector for the question")
    live = trust.withColumnRenamed("uri", "t_uri")
    best = nearest(chunked.join(live.select("t_uri"), F.col("uri") == F.col("t_uri"), "left_semi"), found[0], limit)
    return best.join(live, F.col("uri") == F.col("t_uri")).drop("t_uri").orderBy(F.desc("similarity"), "uri")


def service_embedder(post: Callable[[list[str]], bytes], most: int = 1 << 20) -> Callable[[list[str]], list[list[float]]]:
    """An embedder from a service's raw answers, {"data": [{"index": 0, "embedding": [...]}, ...]} in any order.

    An answer of more than ``most`` bytes, a missing, repeated or strange index, and vectors of several sizes are errors."""

    def run(texts: list[str]) -> list[list[float]]:
        raw = post(texts)
        if len(raw) > most:
            raise ValueError(f"the answer has more than {most} bytes")
        found: dict[int, list[float]] = {}
        for item in json.loads(raw)["data"]:
            if item["index"] in found or not 0 <= item["index"] < len(texts):
                raise ValueError(f"unexpected index {item['index']}")
            found[item["index"]] = [float(x) for x in item["embedding"]]
        if len(found) != len(texts) or len({len(v) for v in found.values()}) > 1:
            raise ValueError("the answer lacks vectors, or they have several sizes")
        return [found[i] for i in range(len(texts))]

    return run


def sync(pages: DataFrame, embedder: Callable[[list[str]], list[list[float]]], replace: Callable[[DataFrame, str, int], None], fingerprint: str) -> None:
    """Chunks and embeds the pages (uri, body) and hands them to ``replace`` (chunks, fingerprint, dimensions) as one state.

    The embedded chunks are written before they are checked and replaced, so that each text is embedded once."""
    made = graph.written(embed(chunks(pages), embedder))
    sizes = [r["n"] for r in made.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    if not sizes:
        raise ValueError("no pages to index")
    if len(sizes) > 1 or not made.where(~vectors.is_valid(F.col("embedding"), sizes[0])).isEmpty():
        raise ValueError("the embedder returned vectors that are not valid")
    replace(made, fingerprint, sizes[0])
