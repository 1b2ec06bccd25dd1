"""Benchmark decontamination with a broadcast hash set of test n-grams.

The normalised windows of the benchmark items (13 words, or a whole shorter
item) form a sorted array of 64-bit Rabin-Karp hashes.  Documents are scanned
once: the rolling hash of every window is looked up, hits are verified word for
word, and the covered words are marked.  The benchmark is a stated set, but its
size is checked all the same: a broadcast holds at most ``MAX_WINDOWS`` windows
and ``BLOCK_BYTES`` bytes.  Beyond that the documents are scanned block by
block, with one block at a time in the driver and the workers, and the hit words
of all blocks are merged before a document is judged or cut.

Defined results: null and word-less texts have no words, no hits and are clean;
null item texts are ignored; null item_ids are left out of the item lists;
repeated items and documents are each judged alike; an empty benchmark or
document table is fine; extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import mapped, quoted, send, stored, unused
from slotloom.llm.words import ALNUM, LOWER, buffers, chunks, covered, scan, text_column, tidy, windows, word_hashes

N_WORDS = 13
#: The bounds of a block; building one takes about ``WINDOW_BYTES`` for a window besides its words, and ``ENTRY_BYTES`` for each item of a window.
MAX_WINDOWS, BLOCK_BYTES, WINDOW_BYTES, ENTRY_BYTES = 400_000, 192 << 20, 400, 64


class _Windows(NamedTuple):
    """Windows of one length: sorted hashes, their words, and the items that have them, as runs."""

    hashes: np.ndarray
    words: bytes
    word_edges: np.ndarray
    items: np.ndarray
    item_edges: np.ndarray


class WindowSet:
    """Windows of benchmark items, by length."""

    def __init__(self, held: dict[int, dict[bytes, tuple[int, set]]], item_ids: list):
        self.item_ids, self.of = item_ids, {}
        for length, found in held.items():
            # By hash; windows of one hash and other words lie side by side.
            words = sorted(found, key=lambda w, found=found: (found[w][0], w))
            hashes, items = [found[w][0] for w in words], [sorted(found[w][1]) for w in words]
            edges = lambda xs: np.cumsum([0, *map(len, xs)])
            self.of[length] = _Windows(np.array(hashes, np.uint64), b"".join(words), edges(words), np.array([i for x in items for i in x], np.int32), edges(items))


def window_blocks(items: Iterable[tuple[object, str]], n: int = N_WORDS, max_windows: int = MAX_WINDOWS) -> Iterator[WindowSet]:
    """The items' windows in blocks, one after the other; at least one block, of no windows if there are none.

    A block ends at so many windows or bytes, of which its windows' items count as well: a sentence that all
    items have is one window with as many entries, and may fill several blocks.
    """
    held: dict[int, dict[bytes, tuple[int, set]]] = defaultdict(dict)
    places: dict[object, int] = {}
    count = size = made = 0
    for item_id, text in items:
        data, offsets = buffers(pa.array([text or ""]))
        starts, ends, doc = scan(data, offsets, ALNUM)
        if not len(starts):
            continue
        length = min(n, len(starts))
        low = data.tobytes().translate(LOWER)
        words = [low[a:b] for a, b in zip(starts, ends)]
        at, hashed = windows(word_hashes(data, starts, ends, True), doc, length)
        for i, h in zip(at.tolist(), hashed.tolist()):
            if count >= max_windows or size >= BLOCK_BYTES:
                yield WindowSet(held, list(places))
                held, places, count, size, made = defaultdict(dict), {}, 0, 0, made + 1
            of, window = held[length], b" ".join(words[i : i + length])
            if window not in of:
                of[window] = (h, set())
                size += WINDOW_BYTES + len(window)
                count += 1
            if item_id not in places:
                places[item_id] = len(places)
                size += ENTRY_BYTES + len(str(item_id))
            if places[item_id] not in of[window][1]:
                of[window][1].add(places[item_id])
                size += ENTRY_BYTES
    if count or not made:
        yield WindowSet(held, list(places))


def hits(data: np.ndarray, offsets: np.ndarray, known: WindowSet):
    """Of a chunk: words per document, which words are hit, word documents, items per document."""
    starts, ends, doc = scan(data, offsets, ALNUM)
    m = len(starts)
    hit = np.zeros(m, bool)
    found: dict[int, set] = defaultdict(set)
    if m:
        hashed = word_hashes(data, starts, ends, True)
        low = None
        for length, of in known.of.items():
            at, h = windows(hashed, doc, length)
            if not len(at) or not len(of.hashes):
                continue
            place = np.minimum(np.searchsorted(of.hashes, h), len(of.hashes) - 1)
            sure = []
            for k in np.flatnonzero(of.hashes[place] == h).tolist():
                i, p = int(at[k]), int(place[k])
                low = data.tobytes().translate(LOWER) if low is None else low
                window = b" ".join([low[starts[j] : ends[j]] for j in range(i, i + length)])
                while p < len(of.hashes) and of.hashes[p] == h[k]:
                    if window == of.words[of.word_edges[p] : of.word_edges[p + 1]]:
                        sure.append(i)
                        found[int(doc[i])].update(known.item_ids[x] for x in of.items[of.item_edges[p] : of.item_edges[p + 1]].tolist())
                    p += 1
            if sure:
                hit |= covered(np.array(sure), length, m)
    return starts, ends, doc, hit, found


def _names(items: set) -> list[str]:
    return sorted(str(x) for x in items if x is not None)


_NO_ITEMS = hashlib.sha256(b"").hexdigest()
BLOCK_HITS = "key string, at array<long>, names array<string>, nameless long"
REPORT = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


def _report(known, passed: list[str], min_share: int):
    """Scan with one block; the columns ``passed`` and the report of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit, n_items, names, shas = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [()] * n, [_NO_ITEMS] * n
            for lo, hi, data, offsets in chunks(text_column(batch.column(batch.num_columns - 1))):
                _, _, doc, hit, found = hits(data, offsets, known.value)
                n_words[lo:hi] = np.bincount(doc, minlength=hi - lo)
                n_hit[lo:hi] = np.bincount(doc[hit], minlength=hi - lo)
                for i, items in found.items():
                    names[lo + i], n_items[lo + i] = _names(items), len(items)
                    shas[lo + i] = hashlib.sha256(",".join(names[lo + i]).encode()).hexdigest()
            columns = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(names, pa.list_(pa.string())), pa.array(shas, pa.string()), pa.array((n_hit > 0) & (min_share * n_hit >= n_words))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *columns], [*passed, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return run


def _block_hits(known):
    """Scan with one of several blocks: of each row (key, text) with hits the places of hit words, and the items."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, data, offsets in chunks(text_column(batch.column(1))):
                _, _, doc, hit, found = hits(data, offsets, known.value)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i, items in found.items():
                    at = np.flatnonzero(hit[first[i] : first[i + 1]])
                    out.append((batch.column(0)[lo + i].as_py(), at.tolist(), _names(items), int(None in items)))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["key", "at", "names", "nameless"])

    return run


def _digest(text):
    """What stands for a text where hits of several blocks meet."""
    return F.sha2(text, 256)


def _items(benchmark: DataFrame) -> Iterator[tuple[object, str]]:
    return ((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator())


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int):
    """(the only block, None), or (None, the hits of all blocks by the digest of the text: key, at, items, nameless)."""
    blocks = window_blocks(_items(benchmark), n, max_windows)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return block, None
    texts, union = docs.where("text is not null").select(_digest(F.col("text")).alias("key"), "text"), None
    while block is not None:
        sent = send(docs.sparkSession, block)
        # Copies of a text have the same hits, so they combine before the shuffle.
        found = texts.mapInArrow(_block_hits(sent), BLOCK_HITS).groupBy("key").agg(F.first("at").alias("at"), F.first("names").alias("names"), F.first("nameless").alias("nameless"))
        found = stored(found, "block-hits")
        sent.destroy()
        union = found if union is None else union.unionByName(found)
        block, following = following, next(blocks, None)
    merged = union.groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("items"), F.max("nameless").alias("nameless")
    )
    return None, stored(merged, "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, min_share: int = 20, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id and the report of each document: words, hit words, items with occurring windows.

    ``contaminated``: some word is hit, and ``min_share`` * hit words >= words.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    block, merged = _scanned(rows, benchmark, n, max_windows)
    if merged is None:
        return rows.mapInArrow(_report(send(docs.sparkSession, block), ["doc_id"], min_share), f"doc_id {kind}, {REPORT}")
    none = send(docs.sparkSession, WindowSet({}, []))
    keyed = rows.select("doc_id", _digest(F.col("text")).alias("own"), "text")
    counted = keyed.mapInArrow(_report(none, ["doc_id", "own"], min_share), f"doc_id {kind}, own string, {REPORT}").select("doc_id", "own", "n_words")
    n_hit, names = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size("at")).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(merged, F.col("own") == F.col("key"), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), (F.size(names) + F.coalesce("nameless", F.lit(0))).cast("long").alias("n_items"), names.alias("items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * min_share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, min_share: int = 20, spans: bool = False, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, or with ``spans`` all documents without their hit words.

    Rows keep all their columns.  With ``spans`` a cleaned text is its remaining
    text, each removed span with the bytes up to the next word; null stays null.
    """
    text_at = docs.columns.index("text")
    block, merged = _scanned(docs.select("text"), benchmark, n, max_windows)
    if merged is None:
        return mapped(docs, _cleaned(send(docs.sparkSession, block), text_at, min_share, spans), docs.columns)
    key, own, at = unused(docs.columns, "key", "own", "at")
    keyed = docs.select(*quoted(docs.columns), _digest(F.col("text")).alias(own))
    found = keyed.join(merged.select(F.col("key").alias(key), F.col("at").alias(at)), F.col(own) == F.col(key), "left").select(*quoted(docs.columns), at)
    return mapped(found, _cut(text_at) if spans else _kept(text_at, min_share), docs.columns)


def _kept(text_at: int, min_share: int):
    """Drops the rows that the places of hit words in the last column call contaminated."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = np.array([len(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()], np.int64)
            n_words = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in chunks(text_column(batch.column(text_at))):
                n_words[lo:hi] = np.bincount(scan(data, offsets, ALNUM)[2], minlength=hi - lo)
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield batch.filter(pa.array(~((n_hit > 0) & (min_share * n_hit >= n_words))))

    return run


def _without(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray, hit: np.ndarray) -> list[str]:
    """The texts of a chunk without their hit words."""
    steps = np.zeros(len(data) + 1, np.int32)
    limit = np.append(starts[1:], len(data))
    limit = np.minimum(limit, offsets[doc + 1])
    np.add.at(steps, starts[hit], 1)
    np.add.at(steps, limit[hit], -1)
    stay = np.cumsum(steps[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(stay)])
    raw = data[stay].tobytes()
    return [raw[kept[a] : kept[b]].decode() for a, b in zip(offsets[:-1], offsets[1:])]


def _with_texts(batch: pa.RecordBatch, text_at: int, new: list[str]) -> pa.RecordBatch:
    """The batch with new texts; null stays null."""
    column = batch.column(text_at)
    text = pa.array([None if old is None else t for old, t in zip(column.to_pylist(), new)], column.type)
    return pa.RecordBatch.from_arrays([text if i == text_at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def _cut(text_at: int):
    """Cuts the words whose places are in the last column, and drops that."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, new = batch.column(batch.num_columns - 1).to_pylist(), []
            for lo, hi, data, offsets in chunks(text_column(batch.column(text_at))):
                starts, _, doc = scan(data, offsets, ALNUM)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                hit = np.zeros(len(starts), bool)
                for i in range(hi - lo):
                    hit[first[i] + np.array(places[lo + i] or [], np.int64)] = True
                new += _without(data, offsets, starts, doc, hit)
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield _with_texts(batch, text_at, new)

    return run


def _cleaned(known, text_at: int, min_share: int, spans: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows_set = known.value
        for batch in batches:
            column = batch.column(text_at)
            keep, new = np.ones(batch.num_rows, bool), []
            for lo, hi, data, offsets in chunks(text_column(column)):
                starts, _, doc, hit, found = hits(data, offsets, windows_set)
                if spans:
                    new += _without(data, offsets, starts, doc, hit) if hit.any() else column.slice(lo, hi - lo).to_pylist()
                elif found:
                    n_words, n_hit = np.bincount(doc, minlength=hi - lo), np.bincount(doc[hit], minlength=hi - lo)
                    keep[lo:hi] = ~((n_hit > 0) & (min_share * n_hit >= n_words))
            if spans:
                batch = _with_texts(batch, text_at, new)
            yield batch.filter(pa.array(keep))

    return run


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("items")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
