"""A Bloom filter, so that joins on few keys move few rows.

The filter has ``BITS_PER_KEY`` bits for each key, between ``LEAST_BITS`` and
``MOST_BITS`` (a broadcast of 2 to 64 MB).  Beyond that it lets more rows through, which
the join after it removes: results never depend on its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from slotloom.llm.shared import mapped, send
from slotloom.llm.words import U64, mix, settled, tidy

LEAST_BITS, MOST_BITS, BITS_PER_KEY, PIECES, HASHES, BUILDERS = 1 << 24, 1 << 29, 8, 64, 3, 64


def bits_for(keys: int) -> int:
    """A power of two."""
    return min(max(LEAST_BITS, 1 << max(0, keys * BITS_PER_KEY - 1).bit_length()), MOST_BITS)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    k = keys.astype(np.int64).view(U64)
    return np.stack([(mix(k + U64(i * 77 + 1)) % U64(bits)).astype(np.int64) for i in range(HASHES)])


def key_filter(keys: DataFrame) -> np.ndarray:
    """The packed bits of a stored DataFrame with one column of longs, built in parts and joined by OR."""
    size = bits_for(keys.count())
    per = size // PIECES // 8

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 100_000):
                place = _places(np.asarray(batch.column(0).slice(at, 100_000)), size).reshape(-1)
                np.bitwise_or.at(packed, place >> 3, (0x80 >> (place & 7)).astype(np.uint8))
        for p in range(PIECES):
            piece = packed[p * per : (p + 1) * per]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["piece", "bits"])

    @settled
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": group["piece"].iloc[:1].to_numpy(), "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group["bits"]]).tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    # BUILDERS tasks at most, so a group of pieces has a bound as well: BUILDERS * MOST_BITS / PIECES bits.
    built = keys.coalesce(BUILDERS).mapInArrow(build, "piece int, bits binary")
    for r in built.groupBy("piece").applyInPandas(merge, "piece int, bits binary").toLocalIterator():
        out[r.piece * per : (r.piece + 1) * per] = np.frombuffer(r.bits, np.uint8)
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    at = _places(keys, 8 * len(bits))
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)


def _filtered(rows: DataFrame, bits, wanted: bool) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(bits.value, np.asarray(batch.column(0))) == wanted))

    return mapped(rows, run, rows.columns)


def likely(rows: DataFrame, bits) -> DataFrame:
    """``rows``, whose first column is a long, without most rows whose key isn't in the broadcast filter."""
    return _filtered(rows, bits, True)


def outside(rows: DataFrame, bits) -> DataFrame:
    """The rows that ``likely`` leaves out: their key is certainly not in the filter."""
    return _filtered(rows, bits, False)


def sent_filter(keys: DataFrame):
    return send(keys.sparkSession, key_filter(keys))
