"""Exact admission of requests by an hour's and a day's limit, in one stateful operator whose state ends by itself.

A client's state is a map from calendar windows to the requests seen in them.  A client has one event-time timer, at
the end of its first open window; when the watermark has passed it, the counts of all windows that ended are taken
away, and the timer goes to the next end.  A client without open windows holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from slotloom.sources import tables

UNITS = {"hour": 3_600_000_000, "day": 86_400_000_000}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """Rows (client, at, key) of one client to (key, admitted)."""

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        lists = T.StructType().add("unit", T.ArrayType(T.StringType())).add("start", T.ArrayType(T.LongType())).add("n", T.ArrayType(T.LongType()))
        self.counts = handle.getValueState("counts", lists.add("timer", "long"))

    def _held(self) -> tuple[dict, int | None]:
        """{(unit, start): n} of the client's open windows, and its timer in milliseconds."""
        found = self.counts.get()
        return ({}, None) if found is None else (dict(zip(zip(found[0], found[1]), found[2])), found[3])

    def _hold(self, held: dict, timer: int | None, spent: bool = False) -> None:
        """Writes the windows with one timer at their first end; a timer that is ``spent`` goes by itself."""
        if not held:
            self.counts.clear()
            return
        first = min(start + UNITS[unit] for unit, start in held) // 1000
        if first != timer:
            if timer is not None and not spent:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.counts.update(([u for u, _ in held], [s for _, s in held], [*held.values()], first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        at, ids = (np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("at", "key"))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        held, timer = self._held()
        fine = np.ones(len(at), bool)
        for unit, limit in self.limits.items():
            starts, first, of, seen = np.unique(at // UNITS[unit], return_index=True, return_inverse=True, return_counts=True)
            windows = [(unit, s) for s in (starts * UNITS[unit]).tolist()]
            before = np.array([held.get(w, 0) for w in windows])
            fine &= np.arange(len(at)) - first[of] + 1 + before[of] <= limit
            held |= dict(zip(windows, (before + seen).tolist()))
        # State is read and written once per client, however many requests and windows a batch has.
        self._hold(held, timer)
        yield pd.DataFrame({"key": ids, "admitted": fine})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        held, timer = self._held()
        self._hold({w: n for w, n in held.items() if w[1] + UNITS[w[0]] > passed}, timer, spent=True)
        return iter(())

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, per_hour: int, per_day: int, by: str = "user_id", ts: str = "ts", key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Streaming (key, admitted): a request is admitted if it is among the first ``per_hour`` of its client's calendar hour and the first ``per_day`` of its day (UTC).

    Requests of one batch are taken by time, those of a later batch after them.  Requests that come later than ``late`` behind the
    newest are dropped with their windows' counts.  Null times and keys are left out; null clients are one client.
    Start it with ``to_table``, which gives it the state store that map state needs.
    """
    timed = requests.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("client"), F.col(ts).cast("timestamp").alias("seen"), F.col(key).cast("long").alias("key")).where("seen is not null and key is not null")
    rows = timed.withWatermark("seen", late).withColumn("at", F.unix_micros("seen"))
    found = rows.groupBy("client").transformWithStateInPandas(Admission({"hour": per_hour, "day": per_day}), "key long, admitted boolean", "append", "EventTime")
    return found.withColumnRenamed("key", key)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there; each epoch is a folder of the table, so an epoch that runs again overwrites itself and nothing comes to the driver.

    With mode ``complete`` every epoch holds the whole result, and ``result`` reads the last.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def result(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """The table that ``to_table`` wrote."""
    rows = stream.sparkSession.read.schema(stream.schema.add("epoch", "long")).parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("epoch") == (rows.agg(F.max("epoch")).first()[0] or 0))
    return rows.drop("epoch")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table in the shared folder, and gives that."""
    path = tables.new_folder(stream.sparkSession, name)
    to_table(stream, path, tables.new_folder(stream.sparkSession, f"{name}-checkpoint"), mode)
    return result(stream, path, mode)
