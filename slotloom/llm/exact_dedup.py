"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its documents' 64-bit
fingerprints.  A filter stores, per quotient (the high bits), the sorted
remainders (the low bits) and their counts, so filters merge without loss by
merging sorted remainders and adding counts.  Filters travel in quotient
ranges; a copy that fills a third of all rows is one remainder per partition.
Fingerprints with a count above one route their documents to byte
verification: they are grouped by fingerprint and SHA-256, and the smallest and
the largest normalised text of a group must be the same bytes; a group with
different texts is grouped by the texts themselves.

Defined results: a null text counts as an empty one; equal means identical
after lower-casing A-Z; of equal rows the largest doc_id stays (null doc_ids
never win against others; among rows with the same largest doc_id each has
``kept`` true, as it is the same document); ``drop_exact_duplicates`` keeps exactly
one row of each group, null and repeated doc_ids included; equal doc_ids with
different texts are different documents; an empty table gives no rows; extra
columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.keyfilter import among, likely, outside, sent_filter
from slotloom.llm.shared import partitions, planned_bytes, quoted, stored, unused
from slotloom.llm.words import LOWER, buffers, settled, text_column, tidy

QUOTIENT_BITS = 20
#: Stored fingerprints of which one part is merged.
PART_BYTES = 32 << 20


class CountingQuotientFilter:
    """Sorted remainders by quotient, with counts.

    ``occupied`` holds the quotients that have a run, ``runs`` each run's
    length, ``remainders`` the runs one after the other, ``counts`` the
    multiplicities.
    """

    def __init__(self, occupied: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.occupied, self.runs, self.remainders, self.counts = occupied, runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        f, c = fingerprints[order], counts[order]
        new = np.flatnonzero(np.diff(f, prepend=f[:1] + np.uint64(1)) != 0) if len(f) else np.zeros(0, np.int64)
        return cls.of_sorted(f[new], np.add.reduceat(c, new) if len(new) else c[:0])

    @classmethod
    def of_sorted(cls, f: np.ndarray, c: np.ndarray) -> CountingQuotientFilter:
        """The filter of rising, different fingerprints."""
        shift = np.uint64(64 - QUOTIENT_BITS)
        occupied, runs = np.unique((f >> shift).astype(np.uint32), return_counts=True)
        return cls(occupied, runs.astype(np.uint32), f & ((np.uint64(1) << shift) - np.uint64(1)), c)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(self.occupied.astype(np.uint64), self.runs)
        return (quotients << np.uint64(64 - QUOTIENT_BITS)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Two by two: the sorted fingerprints of one go to their places among those of the other, and counts of equal ones add up."""
        if not filters:
            return cls.of_sorted(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        runs = [(x.fingerprints(), x.counts) for x in filters]
        while len(runs) > 1:
            runs = [_merged(*runs[i], *runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return cls.of_sorted(*runs[0])

    def slices(self, parts: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Ranges of quotients, for merging in parallel."""
        of = (self.occupied.astype(np.int64) * parts) >> QUOTIENT_BITS
        ends = np.cumsum(self.runs)
        for part in np.unique(of):
            q = np.flatnonzero(of == part)
            lo, hi = int(ends[q[0]] - self.runs[q[0]]), int(ends[q[-1]])
            yield int(part), CountingQuotientFilter(self.occupied[q], self.runs[q], self.remainders[lo:hi], self.counts[lo:hi])

    def to_bytes(self) -> bytes:
        many = np.flatnonzero(self.counts > 1)
        head = np.array([len(self.occupied), len(self.remainders), len(many)], np.uint32)
        return b"".join(x.tobytes() for x in (head, self.occupied.astype(np.uint32), self.runs.astype(np.uint32), self.remainders.astype(np.uint64), many.astype(np.uint32), self.counts[many].astype(np.int64)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, n, m = (int(x) for x in np.frombuffer(raw, np.uint32, 3))
        at = 12

        def take(kind, k):
            nonlocal at
            out = np.frombuffer(raw, kind, k, at)
            at += out.nbytes
            return out

        occupied, runs, remainders = take(np.uint32, q), take(np.uint32, q), take(np.uint64, n)
        counts = np.ones(n, np.int64)
        many = take(np.uint32, m)
        counts[many] = take(np.int64, m)
        return cls(occupied, runs, remainders, counts)


def _merged(f: np.ndarray, c: np.ndarray, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rising lists of fingerprints and their counts as one."""
    if len(f) < len(g):
        f, c, g, d = g, d, f, c
    at = np.searchsorted(f, g)
    same = np.zeros(len(g), bool)
    inside = at < len(f)
    same[inside] = f[at[inside]] == g[inside]
    c = c.copy()
    c[at[same]] += d[same]
    return np.insert(f, at[~same], g[~same]), np.insert(c, at[~same], d[~same])


def _normalised(batch: pa.RecordBatch) -> Iterator[memoryview]:
    data, offsets = buffers(text_column(batch.column(1)))
    lo = int(offsets[0])
    lower = memoryview(data[lo : int(offsets[-1])].tobytes().translate(LOWER))
    for a, b in zip(offsets[:-1] - lo, offsets[1:] - lo):
        yield lower[a:b]


def _digests(with_text: bool, digest_bytes: int, among_bits=None):
    """doc_id, fp, sha, full and, ``with_text``, norm of every row; with a broadcast filter only of rows whose fingerprint may be in it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(_normalised(batch))
            shas = [hashlib.sha256(t).digest() for t in texts]
            short = [s[:digest_bytes] for s in shas]
            fp = np.frombuffer(b"".join(s[:8].ljust(8, b"\0") for s in short), np.int64)
            if among_bits is not None:
                at = np.flatnonzero(among(among_bits.value, fp))
                batch, fp, texts, shas, short = batch.take(pa.array(at)), fp[at], *([x[i] for i in at] for x in (texts, shas, short))
            columns = [batch.column(0), pa.array(fp), pa.array(short, pa.binary()), pa.array(shas, pa.binary())]
            names = ["doc_id", "fp", "sha", "full"]
            if with_text:
                columns.append(pa.array([bytes(t) for t in texts], pa.binary()))
                names.append("norm")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, from merged filters."""
    parts = min(max(2 * partitions(prints.sparkSession), 64, planned_bytes(prints) // PART_BYTES), 1 << QUOTIENT_BITS)

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            cqf = CountingQuotientFilter.build(np.concatenate(held).view(np.uint64))
            rows = [(p, s.to_bytes()) for p, s in cqf.slices(parts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.asarray(batch.column(0)))
            if sum(map(len, held)) >= 4_000_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    @settled
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        cqf = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in group["filter"]])
        many = cqf.counts > 1
        return pd.DataFrame({"fp": cqf.fingerprints()[many].view(np.int64), "n": cqf.counts[many]})

    filters = prints.select("fp").mapInArrow(build, "part int, filter binary")
    return filters.groupBy("part").applyInPandas(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text).

    ``digest_bytes``: how much of a digest tells texts apart before their bytes do.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fp long, sha binary, full binary"
    prints = stored(rows.mapInArrow(_digests(False, digest_bytes), schema), "prints")
    repeated = stored(repeated_fingerprints(prints), "repeated")
    # Byte verification: only rows that a filter of the repeated fingerprints lets through move; the few others among them are groups of one.
    suspects = rows.mapInArrow(_digests(True, digest_bytes, sent_filter(repeated.select("fp"))), f"{schema}, norm binary")
    found = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    groups = stored(suspects.groupBy("fp", "sha").agg(*found, (F.min("norm") == F.max("norm")).alias("verified")), "groups")
    joined = prints.join(groups.select(F.col("sha").alias("g_sha"), "keep_id", "group_size", "verified"), F.col("sha") == F.col("g_sha"), "left")
    sure = _judged(joined.where(F.coalesce("verified", F.lit(True))), F.col("group_size").isNull())
    mixed = groups.where(~F.col("verified")).select(F.col("sha").alias("g_sha"))
    if not mixed.take(1):
        return sure
    apart = stored(suspects.join(mixed, F.col("sha") == F.col("g_sha"), "left_semi"), "apart")
    texts = apart.groupBy(F.col("norm").alias("g_norm")).agg(*found)
    return sure.unionByName(_judged(apart.join(texts, F.col("norm") == F.col("g_norm")), F.lit(False)))


def _judged(rows: DataFrame, alone) -> DataFrame:
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: one row of each group of equal texts stays, with the largest doc_id and all its columns.

    Rows whose fingerprint occurs once never move; the others are grouped by their normalised bytes.
    """
    norm, key, row = unused(docs.columns, "norm", "fp", "row")
    normalised = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    repeated = stored(repeated_fingerprints(stored(docs.select(F.xxhash64(normalised).alias("fp")), "prints")), "repeated")
    bits = sent_filter(repeated.select("fp"))
    keyed = docs.select(F.xxhash64(normalised).alias(key), *quoted(docs.columns))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    one = likely(keyed, bits).groupBy(normalised.alias(norm)).agg(F.max_by(F.struct(*quoted(docs.columns)), order).alias(row))
    return outside(keyed, bits).drop(key).unionByName(one.select(f"{row}.*"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
