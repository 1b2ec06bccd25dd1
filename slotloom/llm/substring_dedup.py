"""Substring deduplication: Rabin-Karp hashes of every window of 35 words, counted in Spark.

1. Each task hashes every window of its documents and sorts blocks of them.
   Windows that repeat inside a block are removed there and then, and only one
   witness of theirs travels on, so a window that a third of all documents share
   is one entry per block.  Other windows travel with their document and
   position, packed by hash range (9 bytes of hash, about 2 of place).
2. Per hash range, equal hashes from different blocks are repeats; their places
   travel to their document's group.
3. Per document the repeated windows merge into maximal removal intervals, which
   join the documents.

A document is addressed by a 64-bit hash of its doc_id and text, so null or
repeated doc_ids are harmless (n documents meet by chance with n^2 / 2^65).  Windows
are compared by two independent Rabin-Karp hashes, 64 bits of one and of the other 8
bits and the number of the hash range, of which there are more the more windows there
are: n windows in r ranges meet by chance with n^2 / (r * 2^73), that is 2e-6 for 30 GB
of text and 4e-3 for 100 TB.

Defined results: null texts and texts without words have no words and keep the
empty text; texts shorter than a window are kept whole; of repeated rows every
window repeats, so all their windows go; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.keyfilter import among, likely, sent_filter
from slotloom.llm.shared import even_keys, mapped, partitions, planned_bytes, quoted, stored, unused
from slotloom.llm.words import NON_SPACE, U64, chunks, covered, mix, ragged, scan, settled, text_column, tidy, windows, word_hashes

N_WORDS = 35
BLOCK_WINDOWS = 1_500_000
BUCKET_BYTES = 16 << 20


def _small(steps: np.ndarray) -> tuple[bytes, bytes]:
    """Steps as single bytes; 255 means that the value stands in the second array."""
    return np.minimum(steps, 255).astype(np.uint8).tobytes(), steps[steps >= 255].astype(np.uint32).tobytes()


def _wide(low: bytes, high: bytes) -> np.ndarray:
    steps = np.frombuffer(low, np.uint8).astype(np.int64)
    steps[steps == 255] = np.frombuffer(high, np.uint32)
    return steps


def _pack(part, hashes, tails, keys, first, place):
    """A row of places: ``first`` marks where a document's run starts, places rise inside a run."""
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    low, high = _small(steps)
    runs, more = _small(np.diff(np.append(first, len(place))))
    return part, hashes.tobytes(), tails.tobytes(), keys.tobytes(), runs, more, low, high


PACKED = "part int, hashes binary, tails binary, keys binary, runs binary, more binary, low binary, high binary"
PLACES = [c.split()[0] for c in PACKED.split(", ") if c.split()[0] not in ("hashes", "tails")]
_PACKED_KINDS = (pa.int32(), *[pa.binary()] * 7)


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    """(keys of each entry, places) of a packed row."""
    runs, steps = _wide(row.runs, row.more), _wide(row.low, row.high)
    first = np.cumsum(runs) - runs
    total = np.cumsum(steps)
    base = total[first] - steps[first] if len(first) else total[:0]
    return np.repeat(np.frombuffer(row.keys, np.int64), runs), total - np.repeat(base, runs)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_PACKED_KINDS)], PACKED.replace(",", "").split()[::2])


def _split(part: np.ndarray, parts: int):
    """(part, indices) for each part that has entries; indices stay in order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _starts(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where runs of one document with rising places start."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (place[1:] < place[:-1])
    return np.flatnonzero(new)


def _place_rows(keys: np.ndarray, place: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
    """Packed rows of repeated windows for the groups of their documents."""
    of = (mix(keys.view(U64)) % U64(len(groups))).astype(np.int64)
    for p, at in _split(of, len(groups)):
        k, x = keys[at], place[at]
        first = _starts(k, x)
        yield _pack(int(groups[p]), np.zeros(0, U64), np.zeros(0, np.uint8), k[first], first, x)


def _repeats(hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which windows occur more than once, which are the first of their kind, an order that brings equal ones together)."""
    order = np.argsort(hashes, kind="stable")
    s, t = hashes[order], tails[order]
    if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((tails, hashes))
        s, t = hashes[order], tails[order]
    same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    repeated, first = np.zeros(len(s), bool), np.ones(len(s), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    first[1:] = ~same
    again, heads = np.zeros(len(s), bool), np.zeros(len(s), bool)
    again[order], heads[order] = repeated, first
    return again, heads, order


def _known(hashes: np.ndarray, tails: np.ndarray, seen_hashes: np.ndarray, seen_tails: np.ndarray) -> np.ndarray:
    """Which windows are among the seen ones."""
    order = np.argsort(seen_hashes, kind="stable")
    s, t = seen_hashes[order], seen_tails[order]
    at = np.minimum(np.searchsorted(s, hashes), len(s) - 1)
    same = s[at] == hashes
    out = same & (t[at] == tails)
    for i in np.flatnonzero(same & ~out):  # the other hash differs: look at all with this one
        a, b = np.searchsorted(s, hashes[i], "left"), np.searchsorted(s, hashes[i], "right")
        out[i] = (t[a:b] == tails[i]).any()
    return out


def _hash_windows(length: int, ranges: np.ndarray, groups: np.ndarray):
    parts = len(ranges)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            hashes, other, keys, place = (np.concatenate([h[i] for h in held]) for i in range(4))
            tails, part = (other & U64(255)).astype(np.uint8), (((other >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int32)
            again, sent, _ = _repeats(hashes, tails)
            rows = list(_place_rows(keys[again], place[again], groups))
            # What repeats here needs no place any more, only its hash, once.
            for sure in (False, True):
                single = np.flatnonzero(sent & (again == sure))
                for p, at in _split(part[single], parts):
                    at, p = single[at], int(ranges[p])
                    if sure:
                        rows.append((p, hashes[at].tobytes(), tails[at].tobytes(), *[b""] * 5))
                    else:
                        first = _starts(keys[at], place[at])
                        rows.append(_pack(p, hashes[at], tails[at], keys[at][first], first, place[at]))
            held.clear()
            return _rows(rows)

        for batch in batches:
            row_keys = np.asarray(batch.column(0))
            for lo, _, data, offsets in chunks(text_column(batch.column(1))):
                starts, ends, doc = scan(data, offsets, NON_SPACE)
                words = word_hashes(data, starts, ends, False)
                at, hashed = windows(words, doc, length)
                if len(at):
                    held.append((hashed, windows(words, doc, length, other=True)[1], row_keys[lo + doc[at]], at - np.searchsorted(doc, doc[at])))
                    count += len(at)
                if count >= BLOCK_WINDOWS:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


def _count(groups: np.ndarray):
    """Of a hash range, the places of hashes that occur more than once; packed places of a document group pass."""
    of_documents = np.sort(groups)

    @settled
    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = group["part"].iloc[0]
        if of_documents[min(np.searchsorted(of_documents, part), len(of_documents) - 1)] == part:
            return group[PLACES]
        found, seen = [], []
        for row in group.itertuples():
            pair = np.frombuffer(row.hashes, U64), np.frombuffer(row.tails, np.uint8)
            if row.runs:
                found.append((*pair, *_unpack(row)))
            else:
                seen.append(pair)
        if not found:
            return pd.DataFrame(columns=PLACES)
        h, t, k, x = (np.concatenate([f[i] for f in found]) for i in range(4))
        again, _, _ = _repeats(h, t)
        if seen:
            again |= _known(h, t, *(np.concatenate([f[i] for f in seen]) for i in range(2)))
        rows = list(_place_rows(k[again], x[again], groups))
        return pd.DataFrame([(r[0], *r[3:]) for r in rows], columns=PLACES)

    return run


def _merge(length: int):
    """Per document the maximal intervals of removed words, as rising edges."""

    @settled
    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, place = [], []
        for row in group.itertuples():
            k, x = _unpack(row)
            keys.append(k), place.append(x)
        k, x = np.concatenate(keys), np.concatenate(place)
        order = np.lexsort((x, k))
        k, x = k[order], x[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (x[1:] > x[:-1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(k)) - 1
        edges = np.stack([x[first], x[last] + length], 1)
        doc = np.flatnonzero(np.diff(k[first], prepend=k[:1] - 1) != 0)
        bounds = np.append(doc, len(first))
        return pd.DataFrame({"key": k[first][doc], "removed": [edges[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]})

    return run


def repeated_spans(docs: DataFrame, length: int = N_WORDS) -> DataFrame:
    """(key, removed): per document with repeated windows its intervals [start, end) of words as int64 pairs."""
    spark = docs.sparkSession
    parts = max(2 * partitions(spark), planned_bytes(docs) // BUCKET_BYTES)
    keys = even_keys(spark, 2 * int(parts))
    ranges, groups = keys[: len(keys) // 2], keys[len(keys) // 2 :]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    hashed = keyed.mapInArrow(_hash_windows(length, ranges, groups), PACKED)
    places = hashed.groupBy("part").applyInPandas(_count(groups), "part int, keys binary, runs binary, more binary, low binary, high binary")
    return places.groupBy("part").applyInPandas(_merge(length), "key long, removed binary")


def _kept(report: bool, text_at: int, outside=None):
    """Rows with their removed words, as a report or as rows with the kept text.

    The last column holds the removed intervals; with ``outside``, a broadcast filter, it
    holds keys, and rows whose key is not in the filter have nothing to remove.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if outside is not None:
                batch = batch.filter(pa.array(~among(outside.value, np.asarray(batch.column(batch.num_columns - 1)))))
                spans = [None] * batch.num_rows
            else:
                spans = batch.column(batch.num_columns - 1).to_pylist()
            n_words, n_removed, out = [], [], []
            old = batch.column(text_at)
            for lo, hi, data, offsets in chunks(text_column(old)):
                starts, ends, doc = scan(data, offsets, NON_SPACE)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                stay = np.ones(len(starts), bool)
                for i in range(hi - lo):
                    if spans[lo + i]:
                        for a, b in np.frombuffer(spans[lo + i], np.int64).reshape(-1, 2).tolist():
                            stay[first[i] + a : first[i] + b] = False
                count = np.diff(first)
                kept = np.bincount(doc[stay], minlength=hi - lo)
                n_words += count.tolist()
                n_removed += (count - kept).tolist()
                # The byte after a kept word, if another kept word of the document follows, becomes its space.
                at = np.flatnonzero(stay)
                follows = np.zeros(len(at), bool)
                follows[:-1] = doc[at[1:]] == doc[at[:-1]]
                lengths = ends[at] - starts[at] + follows
                data = data.copy()
                data[ends[at[follows]]] = 32
                raw = data[ragged(starts[at], lengths)].tobytes()
                edges = np.concatenate([[0], np.cumsum(np.bincount(doc[at], lengths, hi - lo).astype(np.int64))])
                texts = [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]
                out += [hashlib.sha256(t).hexdigest() for t in texts] if report else [t.decode() for t in texts]
            if report:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                text = pa.array([o if r == 0 else t for o, t, r in zip(old.to_pylist(), out, n_removed)], old.type)
                yield pa.RecordBatch.from_arrays([text if i == text_at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    return run


def _with_spans(docs: DataFrame, spans: DataFrame, run, each) -> DataFrame:
    """Documents with removals join their intervals; the others, told by a filter of bounded size, never move.

    ``run`` makes the row function from a filter or None, ``each`` applies it.
    """
    key, own, removed = unused(docs.columns, "key", "own", "removed")
    spans = stored(spans, "spans").select(F.col("key").alias(key), F.col("removed").alias(removed))
    bits = sent_filter(spans.select(key))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias(own), *quoted(docs.columns))
    clean = each(keyed.select(*quoted(docs.columns), own), run(bits))
    joined = likely(keyed, bits).join(spans, F.col(own) == F.col(key), "left").select(*quoted(docs.columns), removed)
    return clean.unionByName(each(joined, run(None)))


def substring_report(docs: DataFrame, length: int = N_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    return _with_spans(rows, repeated_spans(rows, length), lambda bits: _kept(True, 1, bits), lambda df, run: df.mapInArrow(run, schema))


def remove_repeated_spans(docs: DataFrame, length: int = N_WORDS) -> DataFrame:
    """``docs`` with all its columns; texts with removed words are their kept words joined by one space."""
    spans = repeated_spans(docs.select("doc_id", "text"), length)
    return _with_spans(docs, spans, lambda bits: _kept(False, docs.columns.index("text"), bits), lambda df, run: mapped(df, run, docs.columns))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
