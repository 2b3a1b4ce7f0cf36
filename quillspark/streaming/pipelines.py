"""Structured Streaming: incremental index maintenance, delivery de-duplication, run completeness, change notices."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators import code, history
from quillspark.sources.changes import FileChanges
from quillspark.sources.stores import GenerationStore


class IndexMaintainer:
    """Keeps a generation store in step with a changing set of files.

    Each micro-batch is a hint that something changed. The batch lists the files, joins them with the last generation,
    analyzes what changed, merges, checks that the files are still the same, and publishes. ``observed`` and
    ``published`` count hints; the index is current where they are equal. Many changes, or no generation, mean a reset."""

    def __init__(self, store: GenerationStore, list_files: Callable[[], DataFrame], analyze: Callable[[DataFrame], tuple[DataFrame, DataFrame]], most_changes: int = 512, retries: int = 5, wait: float = 0.1) -> None:
        self.store, self.list_files, self.analyze, self.most_changes = store, list_files, analyze, most_changes
        self.retries, self.wait = retries, wait
        self.observed, self.published, self.state = 0, 0, "starting"

    def digest(self, files: DataFrame) -> str:
        parts = files.groupBy(F.substring("digest", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", "path", "digest"))), "\n"), 256).alias("d"))
        return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), "\n"), 256)).first()[0]

    def reconcile(self, _batch: DataFrame | None = None, _id: int = 0) -> None:
        """Brings the store up to date; what fails, or meets changing files, is tried again after waits that double."""
        self.observed += 1
        for attempt in range(self.retries + 1):
            try:
                self._reconcile(self.observed)
                if self.state != "degraded":
                    return
            except Exception:
                self.state = "failed"
                if attempt == self.retries:
                    raise
            if attempt < self.retries:
                time.sleep(self.wait * 2**attempt)

    def _reconcile(self, hint: int) -> None:
        self.state = "pending"
        files = self.list_files().select("path", "digest", "language", "text").persist()
        try:
            digest, old = self.digest(files), self.store.read()
            if old:
                changes = history.document_changes(old["documents"], files).persist()
                upserts, total = changes.where("change = 'upsert'").select("path"), changes.count()
                if not total:
                    self.published, self.state = hint, "current"
                    return
            if not old or total > self.most_changes:
                symbols, relations = self.analyze(files)
            else:
                symbols, relations = self.analyze(files.join(upserts, "path", "left_semi"))
                gone = changes.select("path")
                symbols = symbols.unionByName(old["symbols"].join(gone, "path", "left_anti"))
                relations = relations.unionByName(old["relations"].drop("candidates", "n_candidates", "resolution").join(gone, "path", "left_anti"))
            tables = {"documents": files.select("path", "digest", "language"), "symbols": symbols, "relations": code.resolve(relations, symbols)}
            if self.digest(self.list_files().select("path", "digest")) != digest:
                self.state = "degraded"  # the files changed meanwhile; the next hint starts anew
                return
            self.store.publish(tables, digest)
            self.published, self.state = hint, "current" if hint == self.observed else "pending"
        finally:
            files.unpersist()

    def start(self, hints: DataFrame, checkpoint: str, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
        """Follows a stream of hints. Those that come within ``every`` are one micro-batch, and so one reconciliation."""
        writer = hints.writeStream.foreachBatch(self.reconcile).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    def read_current(self, wait: float = 2.0) -> dict[str, DataFrame]:
        """The current generation, after waiting for it; its paths stay pinned for the caller."""
        end = time.monotonic() + wait
        while self.observed != self.published:
            if time.monotonic() > end:
                raise TimeoutError(f"the index is {self.state}")
            time.sleep(0.02)
        return self.store.read()


class _Kept(StatefulProcessor):
    """State that ends: a timer lets it go ``keep`` seconds after it was last (or first) touched, and a row tells of that.

    Time is the watermark's where the stream has one (``event``), else the clock's."""

    def __init__(self, keep: float | None, event: bool) -> None:
        self.keep, self.event = keep, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def hold(self, timers: object, again: bool) -> None:
        """Sets the timer; with ``again`` one that is set already is put off."""
        if self.keep is None:
            return
        known = list(self.handle.listTimers())
        if known and not again:
            return
        for timer in known:
            self.handle.deleteTimer(timer)
        now = timers.getCurrentWatermarkInMs() if self.event else timers.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(int(max(now, 0) + self.keep * 1000))

    def close(self) -> None:
        """Nothing to release."""


class _Deliveries(_Kept):
    """Keeps the digest of each delivery: the same again is unchanged, another one a conflict."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.digest = handle.getValueState("digest", "digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.digest.get()[0] if self.digest.exists() else None
        for frame in rows:
            results = []
            for digest in frame["digest"]:
                results.append("created" if known is None else "unchanged" if known == digest else "conflict")
                known = known or digest
            yield pd.DataFrame({"delivery_id": key[0], "digest": frame["digest"], "result": results})
        self.digest.update((known,))
        self.hold(timers, again=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        digest = self.digest.get()[0] if self.digest.exists() else None
        self.digest.clear()
        yield pd.DataFrame({"delivery_id": [key[0]], "digest": [digest], "result": ["released"]})


def _timed(keep: float | None, at: str | None) -> str:
    return "None" if keep is None else "ProcessingTime" if at is None else "EventTime"


def deliveries(stream: DataFrame, keep: float | None = None, at: str | None = None) -> DataFrame:
    """(delivery_id, digest, result) of a stream of (delivery_id, digest): created, unchanged or conflict; needs the RocksDB
    state store.

    With ``keep``, a delivery is forgotten so many seconds after it came (by the watermark of column ``at``, or the clock), and
    a row with result released says so; state then holds what came within that time only, and the same id later counts as created."""
    keyed = stream.groupBy("delivery_id")
    return keyed.transformWithStateInPandas(_Deliveries(keep, at is not None), "delivery_id string, digest string, result string", "Append", _timed(keep, at))


class _Runs(_Kept):
    """Follows each run: the next sequence it needs, those that came early (a state row each), and whether it has its outcome."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.next = handle.getValueState("next", "next long, ended boolean, waiting long")
        self.early = handle.getMapState("early", "sequence long", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        need, ended, waiting = self.next.get() if self.next.exists() else (0, False, 0)
        for frame in rows:
            ended = ended or bool((frame["kind"] == "outcome").any())
            for sequence in frame["sequence"].astype(int).tolist():
                if sequence >= need and not self.early.containsKey((sequence,)):
                    self.early.updateValue((sequence,), (True,))
                    waiting += 1
        while waiting and self.early.containsKey((need,)):
            self.early.removeKey((need,))
            need, waiting = need + 1, waiting - 1
        self.next.update((need, ended, waiting))
        self.hold(timers, again=True)
        yield self.told(key, need, ended and not waiting, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        need, ended, waiting = self.next.get() if self.next.exists() else (0, False, 0)
        self.next.clear()
        self.early.clear()
        yield self.told(key, need, ended and not waiting, True)

    def told(self, key: tuple, entries: int, complete: bool, released: bool) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "entries": [entries], "complete": [complete], "released": [released]})


def run_completeness(stream: DataFrame, keep: float | None = None, at: str | None = None) -> DataFrame:
    """(run_id, entries, complete, released) after each batch of a stream of (run_id, sequence, kind).

    With ``keep``, a run that has been silent for so many seconds (by the watermark of column ``at``, or the clock) is let go of,
    with or without its outcome, and a row with released set says how far it had come."""
    keyed = stream.groupBy("run_id")
    return keyed.transformWithStateInPandas(_Runs(keep, at is not None), "run_id string, entries long, complete boolean, released boolean", "Update", _timed(keep, at))


def notices(store: GenerationStore, current: Callable[[], DataFrame], send: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that tells of resources (uri, revision, origin) removed, updated or added since the last batch."""

    def run(_batch: DataFrame, number: int) -> None:
        now, known = current(), store.read().get("resources")
        if known is not None:
            for row in history.resource_changes(known, now).orderBy("uri").toLocalIterator():
                send(row["uri"], row["change"])
        store.publish({"resources": now}, f"batch-{number}")

    return run


def deliveries_due(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(hook, uri, operation): each event (uri, operation) with the hooks (hook, scope, target) whose scope holds the uri.

    Scopes are all (vault), a page, or a prefix by whole segments: an event has a key for each, so that this is an
    equi-join whatever the number of hooks."""
    parts = F.split("uri", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.lit("prefix").alias("k_scope"), F.array_join(F.slice(parts, 1, n), "/").alias("k_target")))
    own = F.array(F.struct(F.lit("vault").alias("k_scope"), F.lit("").alias("k_target")), F.struct(F.lit("page").alias("k_scope"), F.col("uri").alias("k_target")))
    keyed = events.select("uri", "operation", F.inline(F.concat(own, F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<struct<k_scope:string,k_target:string>>")))))
    target = F.when(F.col("scope") == "vault", "").when(F.col("scope") == "prefix", F.regexp_replace(F.coalesce("target", F.lit("")), "/+$", "")).otherwise(F.col("target"))
    named = rules.select("hook", "scope", target.alias("h_target"))
    return keyed.join(named, (F.col("k_scope") == F.col("scope")) & (F.col("k_target") == F.col("h_target"))).select("hook", "uri", "operation")


def deliver(due: DataFrame, send: Callable[[dict], str], timeout: float = 10.0, output: int = 4096, secrets: tuple[str, ...] = ()) -> DataFrame:
    """Sends what is due from the tasks: (hook, uri, operation, result, output). ``send`` gets a row and returns its output.

    A send that takes longer than ``timeout`` seconds or fails is told as such and does not stop the others; outputs are
    cut to ``output`` bytes, and secrets in them are blotted out. Whoever sends must bear a repeat, as tasks may run twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor, TimeoutError

        for frame in frames:
            results, outputs = [], []
            for row in frame.to_dict("records"):
                pool = ThreadPoolExecutor(1)  # one that hangs is left behind
                try:
                    result, said = "delivered", pool.submit(send, row).result(timeout) or ""
                except TimeoutError:
                    result, said = "timeout", ""
                except Exception as e:  # what a hook does is not ours to judge
                    result, said = "failed", str(e)
                pool.shutdown(wait=False)
                for secret in secrets:
                    said = said.replace(secret, "[redacted]") if secret else said
                results.append(result)
                outputs.append(said.encode()[:output].decode("utf-8", "ignore"))
            yield frame.assign(result=results, output=outputs)

    return due.mapInPandas(run, "hook string, uri string, operation string, result string, output string")


def ticks(spark: SparkSession, seconds: int = 30) -> DataFrame:
    """A stream of one row every so many seconds: a hint to look at everything again, changed files too."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()


def file_changes(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """A stream of the files of a folder that are new, changed or gone; ``state`` is a shared folder of the stream's own."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", folder).option("state", state).load()


def file_hints(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that has a row for each new file of a folder. Files that change under their name are seen at a tick."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
