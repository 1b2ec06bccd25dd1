"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[tuple[object, str]] = []
_registered: list = []
_own: dict[str, str] = {}
_sent: list[weakref.ref] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return str(set_dir.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='slotloom-')}"
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/slotloom/{name}-{uuid.uuid4().hex}"
    if not _registered:
        _registered.append(atexit.register(_clean))
    _made.append((spark, path))
    return path


def made() -> list[tuple[object, str]]:
    """What ``fresh_path`` has given out and nobody has removed yet."""
    return list(_made)


def removed(paths: list[tuple[object, str]]) -> None:
    """Removes tables that are no longer read."""
    for spark, path in paths:
        with contextlib.suppress(Exception):  # the session may have ended
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if (spark, path) in _made:
            _made.remove((spark, path))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame as a written table: its lineage is cut, lost executors cost nothing
    that was finished, and later plans know its true size."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def send(spark: SparkSession, value):
    """A broadcast that ``recall`` takes back from the executors."""
    out = spark.sparkContext.broadcast(value)
    _sent.append(weakref.ref(out))
    return out


def recall() -> None:
    """Takes all broadcasts of ``send`` back from the executors; what is used again is sent again."""
    for found in _sent:
        if (broadcast := found()) is not None:
            with contextlib.suppress(Exception):  # its session may have ended
                broadcast.unpersist()
    _sent.clear()


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until none of ``columns`` has it (case doesn't count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list:
    """The columns by name, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def mapped(rows: DataFrame, run, columns: list[str]) -> DataFrame:
    """``mapInArrow`` that gives the first of the columns of ``rows`` back, whatever their names are (Spark's own takes no dots and backticks)."""
    fields = rows.schema.fields
    safe = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(safe, fields[: len(columns)])])
    return rows.toDF(*safe).mapInArrow(run, schema).toDF(*columns)


def _clean() -> None:
    removed(made())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of int columns (Murmur3 with seed 42)."""
    u = np.uint32
    turn = lambda v, n: (v << u(n)) | (v >> u(32 - n))
    h = turn(u(42) ^ (turn(x.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(shift))) * u(factor)
    return (h ^ (h >> u(16))).astype(np.int32)


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """Different ints, at least ``parts``, that a shuffle by hash deals evenly to its partitions."""
    n = partitions(spark)
    each = -(-parts // n)
    found, count, start = [[] for _ in range(n)], 0, 0
    while count < n * each:
        x = np.arange(start, start + 4 * n * each, dtype=np.int32)
        order = np.argsort(to := np.mod(_spark_hash(x).astype(np.int64), n), kind="stable")
        edges = np.searchsorted(to[order], np.arange(n + 1))
        for p in range(n):
            if len(found[p]) < each:
                more = x[order[edges[p] : edges[p + 1]]][: each - len(found[p])].tolist()
                found[p] += more
                count += len(more)
        start += len(x)
    return np.array([k for row in zip(*found) for k in row], np.int32)


def planned_bytes(df: DataFrame) -> int:
    """The size of all that the plan scans, by Catalyst's statistics; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)
