"""Service logs: sessions, acceptances, latency and rate limits, in batch and as streams.

All functions take batch or streaming DataFrames alike unless they say otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotloom.operators import infer, knn, pivots
from slotloom.sources import tables

PER_HOUR, PER_DAY = 5, 100
#: Calendar windows of which a client's counts are held.
WINDOWS_HELD = 64


def logged_requests(requests: DataFrame) -> DataFrame:
    """Requests as they are stored: the address only as its SHA-1."""
    return requests.withColumn("hashed_IP", F.sha1(F.col("ip").cast("binary"))).drop("ip")


def valid_acceptances(accepted: DataFrame, requests: DataFrame) -> DataFrame:
    """Acceptances whose session made a request before."""
    return accepted.join(requests.select("sess_id").distinct(), "sess_id", "left_semi")


def append_acceptances(accepted: DataFrame, requests: DataFrame, path: str) -> None:
    """Appends the valid acceptances to their log; the others are not stored."""
    valid_acceptances(accepted, requests).write.mode("append").parquet(path)


def telemetry(responses: DataFrame) -> DataFrame:
    """Envelopes (response, error, session_id) of responses (sess_id, response, error), as clients get them: the session only where nothing failed."""
    return responses.select("response", "error", F.when(F.col("error").isNull(), F.col("sess_id")).alias("session_id"))


def latency(requests: DataFrame) -> DataFrame:
    """Seconds from start to finish; unfinished requests have none."""
    return requests.withColumn("latency_s", F.unix_micros(F.col("finished_t").cast("timestamp")) / 1e6 - F.unix_micros(F.col("start_t").cast("timestamp")) / 1e6)


def request_counts(requests: DataFrame, unit: str, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests per client and tumbling window (batch)."""
    return requests.groupBy(by, F.date_trunc(unit, ts).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def admitted(requests: DataFrame, limit: int, unit: str, by: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Adds admitted: the first ``limit`` requests of a client in a window (batch); a window of one client is one group."""
    order = Window.partitionBy(by, F.date_trunc(unit, ts)).orderBy(ts, key)
    return requests.withColumn("admitted", F.row_number().over(order) <= limit)


def admitted_stream(requests: DataFrame, limit: int, unit: str, by: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Streaming admission: (key, admitted); the first ``limit`` requests of a client in a calendar window, in the order of arrival.

    Requests of one batch are taken by time.  A client's state is the counts of the last
    ``WINDOWS_HELD`` windows it was seen in; a request of an older window isn't admitted.
    """
    starts = F.date_trunc(unit, F.col(ts)).cast("timestamp")
    rows = requests.select(F.col(by).cast("string").alias("client"), F.unix_micros(starts).alias("window"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(key).cast("long").alias("key"))

    def run(client, batches, state):
        frames = [b for b in batches if len(b)]
        held = dict(zip(*[list(x) for x in state.get])) if state.exists else {}
        if not frames:
            return
        rows = pd.concat(frames).sort_values(["at", "key"], kind="stable")
        out = []
        for window, at_key in zip(rows["window"].tolist(), rows["key"].tolist()):
            fresh = window in held or len(held) < WINDOWS_HELD or window > min(held)
            n = held.get(window, 0) + 1
            if fresh:
                held[window] = n
                if len(held) > WINDOWS_HELD:
                    del held[min(held)]
            out.append((at_key, bool(fresh and n <= limit)))
        state.update(([*held], [*held.values()]))
        yield pd.DataFrame(out, columns=["key", "admitted"])

    found = rows.groupBy("client").applyInPandasWithState(run, "key long, admitted boolean", "windows array<long>, counts array<long>", "append", "NoTimeout")
    return found.withColumnRenamed("key", key)


def predicted_batches(queries: DataFrame, rows: DataFrame, path: str, checkpoint: str, k: int = knn.K):
    """Live predictions: the votes for each batch of a stream of (vec_id, embedding) against stored rows, appended by epoch.

    The rows are dealt to cells once; each batch is joined with the cells that it needs, and never comes to the driver.
    """
    cells = pivots.PivotJoin(rows, k)

    def write(batch: DataFrame, epoch: int) -> None:
        knn.vote(cells.join(batch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def annotated_batches(sources: DataFrame, bundle, path: str, checkpoint: str, filter_types: bool = True):
    """Live inference: the ranked predictions of each batch of a stream of (file, text), appended by epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        infer.predicted(batch, bundle, filter_types).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed_counts(events: DataFrame, width: str, late: str, by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Streaming counts per tumbling window, with a watermark for late rows."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = timed.groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), by, "n")


def joined_acceptances(accepted: DataFrame, requests: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stream-stream join: acceptances with their session's request, at most ``within`` later; state is dropped by watermark."""
    a = accepted.withWatermark("timestamp", late).alias("a")
    r = requests.select(F.col("sess_id").alias("r_sess"), F.col("start_t").cast("timestamp").alias("r_start"), *[c for c in requests.columns if c not in ("sess_id", "start_t")]).withWatermark("r_start", late).alias("r")
    return a.join(r, F.expr(f"sess_id = r_sess and timestamp >= r_start and timestamp <= r_start + interval {within}"))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends a request log as it arrives; a batch that runs again overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
