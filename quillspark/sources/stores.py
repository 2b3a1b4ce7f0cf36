"""Stores in a shared folder: content-addressed snapshots, generations with a pointer, partitioned indexes, append-only records.

Data files are Parquet written by Spark. A pointer is a folder of small numbered files; the one with the greatest number
names what is current. A new one is put in place by rename, complete and under the next number, after the data is there,
so readers see the old or the new state and never none, and a failed job leaves the old one."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import audit, trace


#: Earlier states that a pointer keeps, for readers that have just listed them.
KEPT_STATES = 10


class Conflict(Exception):
    """The pointer is not what the writer expected."""


class Pointer:
    """A small JSON state, replaced only if it still has an expected digest.

    Of two writers that expect one state, the rename of the second to the same number fails, as the name is taken; a
    local file system checks that less strictly than a distributed one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _at(self, name: str):  # noqa: ANN202  a path of the JVM
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self) -> tuple[int, dict | None, str | None]:
        for number in reversed(self._numbers()):
            stream = self.fs.open(self._at(f"{number}.json"))
            try:
                raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            return number, json.loads(raw), hashlib.sha256(raw.encode()).hexdigest()
        return 0, None, None

    def read(self) -> tuple[dict | None, str | None]:
        """The content and its digest, or nulls."""
        return self._read()[1:]

    def replace(self, content: dict, expected: str | None) -> str:
        number, _, digest = self._read()
        if digest != expected:
            raise Conflict(self.path)
        raw = json.dumps(content, sort_keys=True)
        new, target = self._at(f"{uuid.uuid4().hex}.new"), self._at(f"{number + 1}.json")
        stream = self.fs.create(new, False)
        stream.write(bytearray(raw.encode()))
        stream.close()
        if self.fs.exists(target) or not self.fs.rename(new, target):
            self.fs.delete(new, False)
            raise Conflict(self.path)
        for old in self._numbers()[:-KEPT_STATES]:
            self.fs.delete(self._at(f"{old}.json"), False)
        return hashlib.sha256(raw.encode()).hexdigest()


class SnapshotStore:
    """Pages as content-addressed objects, with a manifest a snapshot."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.current = spark, root.rstrip("/"), Pointer(spark, f"{root.rstrip('/')}/current.json")

    def publish(self, pages: DataFrame, expected: str | None) -> str:
        """Writes objects (path, content) that are not there yet and a manifest, then moves the pointer."""
        entries = pages.select("path", F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("size"), "content")
        # in parts, so that no task holds all pages
        named = entries.select(F.coalesce("path", F.lit("")).alias("uri"), F.coalesce("digest", F.lit("")).alias("revision"))
        digest = audit.snapshot_digest(named).first()["digest"].removeprefix("sha256:")
        known, _ = self.current.read()
        new = entries.select("digest", "content").dropDuplicates(["digest"])
        if known:
            new = new.join(self.spark.read.parquet(f"{self.root}/objects").select("digest"), "digest", "left_anti")
        new.write.mode("append").parquet(f"{self.root}/objects")
        entries.select("path", "digest", "size").write.mode("overwrite").parquet(f"{self.root}/manifests/{digest}")
        return self.current.replace({"manifest": digest}, expected)

    def read(self) -> DataFrame:
        """(path, content) of the current snapshot; a size or digest that is not the manifest's fails the read."""
        known, _ = self.current.read()
        if known is None:
            return self.spark.createDataFrame([], "path string, content binary")
        manifest = self.spark.read.parquet(f"{self.root}/manifests/{known['manifest']}")
        met = manifest.join(self.spark.read.parquet(f"{self.root}/objects"), "digest", "left")
        fine = F.coalesce((F.length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("digest")), F.lit(False))
        return met.select("path", F.when(fine, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged object: "), "path")).cast("binary")).alias("content"))


class GenerationStore:
    """Immutable generations of several tables, named by a digest; one is current, a few older ones are kept."""

    def __init__(self, spark: SparkSession, root: str, kept: int = 3) -> None:
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept
        self.current = Pointer(spark, f"{self.root}/current.json")

    def publish(self, tables: dict[str, DataFrame], digest: str) -> str:
        """Writes a generation unless it is current already, and moves the pointer to it."""
        known, mark = self.current.read()
        if known and known["generation"] == digest:
            return digest
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{self.root}/generation={digest}/{name}")
        earlier = [g for g in (known or {}).get("earlier", []) if g != digest]
        if known:
            earlier = [known["generation"], *earlier]
        self.current.replace({"generation": digest, "tables": sorted(tables), "earlier": earlier[: self.kept]}, mark)
        for old in earlier[self.kept :]:
            self.dispose(old)
        return digest

    def read(self) -> dict[str, DataFrame]:
        """The current generation's tables; the paths stay pinned for this reader."""
        known, _ = self.current.read()
        if known is None:
            return {}
        return {n: self.spark.read.parquet(f"{self.root}/generation={known['generation']}/{n}") for n in known["tables"]}

    def dispose(self, digest: str) -> None:
        known, _ = self.current.read()
        if known and known["generation"] == digest:
            raise Conflict("the current generation is not disposed of")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generation={digest}")
        self.current.fs.delete(path, True)


class VectorIndex:
    """Chunks by scope in Parquet; a scope is replaced as a whole, then its facts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def replace(self, chunks: DataFrame, scope: str, model: str, fingerprint: str, dimensions: int) -> None:
        version = uuid.uuid4().hex
        path = f"{self.root}/chunks/scope={scope}/{version}"
        chunks.write.parquet(path)
        meta = Pointer(self.spark, f"{self.root}/meta/{scope}.json")
        meta.replace({"model": model, "fingerprint": fingerprint, "dimensions": dimensions, "path": path}, meta.read()[1])

    def meta(self, scope: str) -> dict | None:
        return Pointer(self.spark, f"{self.root}/meta/{scope}.json").read()[0]

    def read(self, scope: str) -> DataFrame:
        known = self.meta(scope)
        if known is None:
            raise ValueError("no index for this scope")
        return self.spark.read.parquet(known["path"])


class SourceCursor:
    """Where a listing is to be resumed, by repository: a page of an unfinished sync, and after a complete one the time it
    began less ``overlap`` seconds, so that late records are met again (appending them twice does nothing)."""

    def __init__(self, spark: SparkSession, root: str, repository: str, overlap: int = 60) -> None:
        name = hashlib.sha256(repository.encode()).hexdigest()[:32]
        self.pointer, self.overlap = Pointer(spark, f"{root.rstrip('/')}/cursors/{name}"), overlap

    def load(self) -> tuple[dict, str | None]:
        """({since, page}, what to expect when committing)."""
        found, mark = self.pointer.read()
        return found or {"since": None, "page": 1}, mark

    def paused(self, since: float | None, page: int, expected: str | None) -> str:
        return self.pointer.replace({"since": since, "page": page}, expected)

    def completed(self, began: float, expected: str | None) -> str:
        return self.pointer.replace({"since": began - self.overlap, "page": 1}, expected)


class RecordStore:
    """Append-only records, each key once: equal content again is unchanged, other content under a key is a conflict."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], content: list[str]) -> None:
        self.spark, self.path, self.key, self.content = spark, path, key, content

    def read(self, schema: str | None = None) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.parquet(self.path)

    def record(self, new: DataFrame) -> dict[str, int]:
        """Appends what is new; counts by result."""
        old = self.read()
        if old is None:
            old = new.limit(0)
        found = trace.append_result(old, new, self.key, self.content).persist()
        try:
            counts = {r["result"]: r["count"] for r in found.groupBy("result").count().collect()}
            found.where("result = 'created'").drop("result").write.mode("append").parquet(self.path)
        finally:
            found.unpersist()
        return counts
