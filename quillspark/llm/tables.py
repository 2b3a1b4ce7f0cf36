"""Small helpers that the operators share: reading a table, columns that are carried, batches to tasks, and the shared folder."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` that an operator uses, and all others in one struct, so that no name of the operator's own
    can meet one of theirs, whatever they are called."""
    known = [docs[f"`{c}`"] for c in docs.columns if c in used]
    others = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in used]
    return docs.select(*known, F.struct(F.lit(0).alias("n"), *others).alias("others"))


def released(frame: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, in their order, from a frame that came of ``held(docs, *used)``."""
    return frame.select(*[F.col(c) if c in used else F.col("others").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of a batch that goes to Python while a table is written, where the session does not say: texts are long,
#: and a batch is held several times.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(2_000), "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that hold while something runs. Those that the session has itself stay; the others are taken back after."""
    new = [k for k in wanted if spark.conf.get(k, None) is None]
    for k in new:
        spark.conf.set(k, wanted[k])
    try:
        yield
    finally:
        for k in new:
            spark.conf.unset(k)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under the warehouse where that is unset (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def fresh(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing of it.

    What the write shuffled is of no use afterwards, so those files go at once, not when the driver collects garbage."""
    spark = frame.sparkSession
    path = fresh(spark, what)
    with settings(spark, BATCH | {_CLEAN: "true"}):
        frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out), path)
    return out


_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def removed(*frames: DataFrame) -> None:
    """Removes the files of tables made by ``written`` that nothing reads any more."""
    for frame in frames:
        known, path = _WRITTEN.pop(id(frame), (lambda: None, ""))
        if known() is frame:
            spark = frame.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Keys of at most so many bytes are sent to every task; more of them are shuffled.
BROADCAST = 64 << 20


def small(keys: DataFrame, width: int) -> DataFrame:
    """``keys``, a written table's rows of about ``width`` bytes, marked for broadcast if their number allows it."""
    return F.broadcast(keys) if keys.count() * width <= BROADCAST else keys
