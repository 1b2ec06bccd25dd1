"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and the master is local, one of this process's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="slotloom-engine-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that goes when the driver's process ends."""
    if not _made:
        atexit.register(_remove)
    path = f"{shared_folder(spark)}/engine/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes a table that ``written`` made and nothing reads any more, before the process ends."""
    folders = {os.path.basename(os.path.dirname(path)) for path in df.inputFiles()}
    for made in [x for x in _made if os.path.basename(x[1]) in folders]:
        _delete(*made)
        _made.remove(made)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """In here, shuffle files go as soon as the action that made them ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to tasks by a key, however few bytes or files they come in: for steps whose work is much more than their bytes.

    A given number of partitions stays as it is, so that small tables don't run such a step in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """A different int for each of ``parts`` groups that are dealt by it: ``repartition(parts, key)`` gives every task one of them."""
    some = 32 * parts
    key = F.col("id").cast("int")
    found = {r.task: r.key for r in spark.range(some).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("task")).agg(F.min(key).alias("key")).collect()}
    # A task that none of these meet shares another's; that is very rare, and as right.
    return [found.get(task, some + task) for task in range(parts)]


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file of this name, on any file system that Spark knows."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(there, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _remove() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)
