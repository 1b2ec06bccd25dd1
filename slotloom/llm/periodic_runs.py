"""Periodic runs: stretches of words that repeat with some period, and texts with one copy of each left.

Every document is judged by itself, so rows never move.  Batches of whole documents are worked
on at once with numpy:

1. Karp-Miller-Rosenberg names: words get numbers inside their document (level 0); the name
   of 2^k words is the number of the pair of names of its halves.  A name that occurs once in
   its document can't match anything and isn't followed to the next level, so levels end as
   soon as nothing repeats.
2. Grid candidates: a run of period p has at least g = max(p, 12 - p) places i whose words i
   and i + p agree, one after the other, so four words agree at one of the places 0, s, 2s, ...
   with s = g - 3.  Only these places are compared: n ln n of them for n words.
3. A candidate is extended to the right and to the left by descending name levels (longest
   common extensions), which gives the whole stretch of period p.  A stretch that was found
   with several periods keeps the smallest.

Memory: names of ``LEVELS`` levels at most for the words of one document, fewer for documents
beyond ``NAME_BYTES`` of names (the top level then is applied again and again), and candidates in
blocks of ``BLOCK``.

Defined results: null and empty texts, and texts of white space, have no words and no runs; the
words of texts without runs stay as they are, joined by one space where the text is collapsed;
repeated rows and doc_ids are judged alone; a null doc_id has no decimal, so nothing is folded for
it; an empty table gives no rows; very long texts are one chunk of their own; extra columns pass
through ``collapse_runs`` whatever their names are and are ignored by ``run_report``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import mapped
from slotloom.llm.words import NON_SPACE, chunks, ragged, scan, text_column, tidy

MIN_LENGTH = 12
SEED = 4
LEVELS = 24
NAME_BYTES = 256 << 20
BLOCK = 1 << 18


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each word, equal where word and document are."""
    if not len(starts):
        return np.zeros(0, np.int32)
    sizes = ends - starts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    raw = data[ragged(starts, sizes)]
    column = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw))
    numbers = np.asarray(column.dictionary_encode().indices).astype(np.int64)
    return _renumbered(doc.astype(np.int64) * (int(numbers.max()) + 1) + numbers)


def _renumbered(keys: np.ndarray) -> np.ndarray:
    """Small numbers for the keys that occur more than once, -1 for the others."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    names = np.cumsum(new) - 1
    single = new & np.append(new[1:], True)
    out = np.empty(len(s), np.int32)
    out[order] = np.where(single, -1, names)
    return out


def name_levels(words: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """Names of 1, 2, 4, ... words from each place; -1 where nothing else of the document has the name."""
    out, n = [words], len(words)
    while len(out) < levels:
        half, below = 1 << (len(out) - 1), out[-1]
        if n <= half:
            break
        at = np.flatnonzero((below[: n - half] >= 0) & (below[half:] >= 0))
        if not len(at):
            break
        names = np.full(n, -1, np.int32)
        names[at] = _renumbered(below[at].astype(np.int64) << 32 | below[at + half].astype(np.int64))
        if (names < 0).all():
            break
        out.append(names)
    return out


def _extended(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from a and b on to the right (``way`` 1), or before them to the left (-1), by descending levels; ``limit`` bounds it."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step, level = 1 << k, names[k]
        live = np.arange(len(a))
        while len(live):
            live = live[got[live] + step <= limit[live]]
            at = got[live] if way > 0 else -got[live] - step
            x = level[a[live] + at]
            live = live[(x >= 0) & (x == level[b[live] + at])]
            got[live] += step
            if k < len(names) - 1:
                break  # a lower level can match once at most
    return got


def _grid(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left place, period) of the candidates of documents with their first word and number of words, in blocks."""
    docs = np.flatnonzero(count >= MIN_LENGTH)
    periods = count[docs] // 2
    # Blocks of (document, period) pairs, with the number of grid places of each.
    pair_edges = np.concatenate([[0], np.cumsum(periods)])
    at = 0
    while at < pair_edges[-1]:
        pairs = np.arange(at, min(at + BLOCK, pair_edges[-1]))
        at = pairs[-1] + 1
        own = np.searchsorted(pair_edges, pairs, "right") - 1
        p = pairs - pair_edges[own] + 1
        step = np.maximum(p, MIN_LENGTH - p) - SEED + 1
        n = count[docs[own]]
        places = (n - p - SEED) // step + 1
        edges = np.concatenate([[0], np.cumsum(places)])
        low = 0
        while low < len(pairs):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BLOCK, "right")) - 1)
            # One period of one document may have more places than a block.
            for start in range(int(edges[low]), int(edges[high]), 4 * BLOCK):
                flat = np.arange(start, min(start + 4 * BLOCK, int(edges[high])))
                which = np.searchsorted(edges, flat, "right") - 1 if high - low > 1 else np.full(len(flat), low)
                yield first[docs[own[which]]] + (flat - edges[which]) * step[which], p[which]
            low = high


def find_runs(words: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; starts count from the document's first word."""
    edges = np.searchsorted(doc, np.arange(documents + 1))
    first, count = edges[:-1], np.diff(edges)
    none = (np.zeros(0, np.int64),) * 4
    names = name_levels(words, int(min(LEVELS, max(4, NAME_BYTES // (4 * len(words) + 1)))))
    if len(names) < 3:
        return none  # not even four words repeat
    seed, found = names[2], []
    # Documents without four words that repeat have no candidates.
    repeats = np.zeros(documents, bool)
    repeats[doc[seed >= 0]] = True
    for a, p in _grid(first, np.where(repeats, count, 0)):
        hit = np.flatnonzero((seed[a] >= 0) & (seed[a] == seed[a + p]))
        if not len(hit):
            continue
        a, p = a[hit], p[hit]
        own = doc[a]
        b = a + p
        right = _extended(names, a, b, edges[own + 1] - b, 1)
        left = _extended(names, a, b, a - first[own], -1)
        start, length = a - left, left + right + p
        good = length >= np.maximum(MIN_LENGTH, 2 * p)
        if good.any():
            found.append(np.unique(np.stack([start, length, p], 1)[good], axis=0))
            if sum(len(f) for f in found) > BLOCK:
                found = [_smallest(np.concatenate(found))]
    if not found:
        return none
    start, length, p = _smallest(np.concatenate(found)).T
    own = doc[start]
    order = np.lexsort((p, start))
    return own[order], (start - first[own])[order], length[order], p[order]


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of the rows (start, length, period), the one with the smallest period of each stretch."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def folded_places(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place of a document of n words, for the checksum h of its id; None where all stay."""
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _scanned(texts: pa.Array, ids: pa.Array | None) -> Iterator[tuple]:
    """For chunks of documents: first row, end row, bytes, starts, ends and documents of their words, folded where ``ids`` say so."""
    for lo, hi, data, offsets in chunks(texts):
        starts, ends, doc = scan(data, offsets, NON_SPACE)
        if ids is not None:
            edges = np.searchsorted(doc, np.arange(hi - lo + 1))
            places = np.arange(len(starts))
            for i, x in enumerate(ids.slice(lo, hi - lo).to_pylist()):
                if x is not None and (moved := folded_places(int(edges[i + 1] - edges[i]), zlib.crc32(str(x).encode()))) is not None:
                    places[edges[i] : edges[i + 1]] = edges[i] + moved
            starts, ends = starts[places], ends[places]
        yield lo, hi, data, starts, ends, doc


def _kept(doc: np.ndarray, edges: np.ndarray, runs: tuple) -> np.ndarray:
    """Which words no run holds after its first period."""
    own, start, length, p = runs
    steps = np.zeros(len(doc) + 1, np.int64)
    np.add.at(steps, edges[own] + start + p, 1)
    np.add.at(steps, edges[own] + start + length, -1)
    return np.cumsum(steps[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, stay: np.ndarray, documents: int) -> list[bytes]:
    """Each document's kept words joined by one space."""
    at = np.flatnonzero(stay)
    sizes = ends[at] - starts[at]
    follows = np.zeros(len(at), bool)
    follows[1:] = doc[at[1:]] == doc[at[:-1]]
    out = np.full(int(sizes.sum()) + int(follows.sum()), 32, np.uint8)
    to = np.cumsum(sizes + follows) - sizes
    out[ragged(to, sizes)] = data[ragged(starts[at], sizes)]
    edges = np.concatenate([[0], np.cumsum(np.bincount(doc[at], sizes + follows, documents).astype(np.int64))])
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in REPORT.split(", ")]


def _report(fold: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts, ends, doc in _scanned(text_column(batch.column(1)), batch.column(0) if fold else None):
                n = hi - lo
                edges = np.searchsorted(doc, np.arange(n + 1))
                runs = own, start, length, p = find_runs(word_numbers(data, starts, ends, doc), doc, n)
                texts = _joined(data, starts, ends, doc, _kept(doc, edges, runs), n)
                at = np.searchsorted(own, np.arange(n + 1))
                # The longest run of each document: of equal ones the first, as they ascend by start and period.
                order = np.lexsort((np.arange(len(own)), -length, own))
                has = np.diff(at) > 0
                top = order[at[:-1][has]]
                best = [pa.array(_spread(v, has), pa.int64(), mask=~has) for v in (start[top], length[top], p[top], 1000 * length[top] // p[top])]
                lines = [f"{s},{x},{q}\n" for s, x, q in zip(start.tolist(), length.tolist(), p.tolist())]
                listed = ["".join(lines[x:y]) for x, y in zip(at[:-1], at[1:])]
                shas = [pa.array([hashlib.sha256(t).hexdigest() for t in column], pa.string()) for column in ([x.encode() for x in listed], texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.diff(at), pa.int64()), *best, *shas], ["doc_id", *_NAMES])

    return run


def _spread(values: np.ndarray, has: np.ndarray) -> np.ndarray:
    out = np.zeros(len(has), np.int64)
    out[has] = values
    return out


def _collapsed(text_at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, texts = batch.column(text_at), []
            for lo, hi, data, starts, ends, doc in _scanned(text_column(old), None):
                n = hi - lo
                runs = find_runs(word_numbers(data, starts, ends, doc), doc, n)
                stay = _kept(doc, np.searchsorted(doc, np.arange(n + 1)), runs)
                changed = np.bincount(doc[~stay], minlength=n) > 0
                joined = _joined(data, starts, ends, doc, stay & changed[doc], n)
                texts += [t.decode() if c else o for t, c, o in zip(joined, changed, old.slice(lo, n).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, old.type) if i == text_at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def run_report(docs: DataFrame, fold: bool = False) -> DataFrame:
    """doc_id and ``REPORT`` of every row; ``fold`` first repeats words in documents that the checksum of their doc_id picks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_report(fold), f"doc_id {kind}, {REPORT}")


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, starts, ends, doc in _scanned(text_column(batch.column(1)), None):
                own, *rest = find_runs(word_numbers(data, starts, ends, doc), doc, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + own)), *(pa.array(r, pa.int64()) for r in rest)], ["doc_id", "start", "length", "period"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns; texts with runs keep the words outside of them and one period of each, joined by one space."""
    return mapped(docs, _collapsed(docs.columns.index("text")), docs.columns)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold=True)
