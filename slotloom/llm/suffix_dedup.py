"""Exact substring deduplication of bytes with suffix arrays: every byte inside a 200-byte string that also starts anywhere else goes.

1. Anchors: of the 32-byte grams of a window of 200 bytes, the one with the least hash is the
   window's anchor, so equal windows have equal anchors, and about one position in 85 is one.
   Spark counts the anchors of all documents.  A window whose anchor occurs once can't repeat;
   what is left are regions of text, and only they are sorted.
2. Shards: a task gathers regions up to ``SHARD`` bytes, sorts their suffixes by Larsson and Sadakane's
   refinement (groups of suffixes that agree in h bytes are sorted by the rank of what
   follows, until all are single) and takes the common prefixes of neighbours by Kasai's
   algorithm, in lanes of numpy.  Neighbours with 200 common bytes are repeats of the shard, and only the
   first of its kind goes on as the shard's witness.
3. Merge: witnesses meet by their anchors, in rows of runs of windows round one anchor.  A row's
   suffixes at the anchors come in the order of the shard's suffix array; rows of different
   shards are merged by binary search, two by two.  Equal windows of different shards have the anchor
   at the same place, the same bytes before and the same bytes from it on, which common prefixes of
   neighbours in the merged order (and in the order of the reversed bytes before) tell.
4. Per document, the repeated windows merge into maximal removed intervals.

Bytes are compared, not hashes, but for anchors that occur very often (a line that a third of all documents
share, before and after which all kinds of text stand): windows round them are dealt by their own hash and
compared by 128 bits of it, so no task gets all of them.  n of those meet by chance with n^2 / 2^129.

Defined results: null texts count as empty ones; texts below 200 bytes are kept whole; of repeated rows all
their windows go; an empty table gives no rows; very long texts are worked on in overlapping pieces of
``PIECE`` bytes; rows are told apart by a 64-bit hash of doc_id and text, so null and repeated doc_ids are
harmless; extra columns pass through ``remove_repeated_bytes`` whatever their names are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.keyfilter import among, sent_filter
from slotloom.llm.shared import even_keys, mapped, partitions, planned_bytes, send, stored
from slotloom.llm.substring_dedup import _with_spans
from slotloom.llm.words import U64, _splitmix, buffers, chunks, give_back, mix, ragged, settled, text_column, tidy

LENGTH = 200
GRAM = 32
#: Positions of a shard: three of their numbers fit in 63 bits.
SHARD = (1 << 19) - 1
PIECE = 1 << 18
BUCKET_BYTES = 8 << 20
#: An anchor is frequent from this many occurrences on, or from one in ``FREQUENT_SHARE`` of all, so at most that many are.
FREQUENT, FREQUENT_SHARE = 2000, 1_000_000
SENTINEL = 255  # in no UTF-8 text
FIRST = 5
LANES = 4096
SPANS, PIECES, WINDOWS = 0, 1, 2

ROW = "part int, kind int, a binary, b binary, c binary, keys binary, place binary, text binary"
_ROW = [c.split()[0] for c in ROW.split(", ")]
_KINDS = (pa.int32(), pa.int32(), *[pa.binary()] * 6)


# -- anchors ----------------------------------------------------------------------------------------------------------


@functools.lru_cache(4)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = _splitmix(seed) | 1
    up, down = np.full(2 * PIECE, base, U64), np.full(2 * PIECE, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64), np.array([_splitmix(seed * 1000 + b) for b in range(256)], U64)


def gram_hashes(data: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on."""
    n = len(data)
    up, down, table = _powers(seed)
    sums = np.zeros(n + 1, U64)
    np.cumsum(table[data] * up[:n], dtype=U64, out=sums[1:])
    return mix((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size])


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, place of the anchor of the window that starts at each position): the leftmost gram with the least hash."""
    hashes = gram_hashes(data, gram)
    width, n = length - gram + 1, len(hashes)
    rows = -(-n // width)
    # The upper bits are the hash, the lower ones the place: the leftmost of equal grams is least.
    keyed = np.full(rows * width, ~U64(0))
    keyed[:n] = (hashes & ~U64(0x3FFFFF)) | np.arange(n, dtype=U64)
    blocks = keyed.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return hashes, (least & U64(0x3FFFFF)).astype(np.int64)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, window starts, their rows, their places in the document) of texts in pieces that hold every window once."""
    for lo, hi, data, offsets in chunks(column, PIECE):
        for at in range(0, max(1, len(data) - length + 1) if hi - lo == 1 else 1, PIECE):
            piece = data[at : at + PIECE + length - 1] if hi - lo == 1 else data
            if len(piece) < length:
                continue
            sizes = np.diff(offsets) if hi - lo > 1 else np.array([len(piece)])
            starts = offsets[:-1] if hi - lo > 1 else np.zeros(1, np.int64)
            many = np.maximum(sizes - length + 1, 0)
            first = ragged(starts, many)
            own = np.repeat(np.arange(len(sizes)), many)
            yield piece, first, lo + own, first - starts[own] + at


def _changes(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _anchor_counts(length: int, gram: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times, pa.int64())], ["anchor", "n"])

        for batch in batches:
            for data, starts, own, _ in _pieces(text_column(batch.column(0)), length):
                if not len(starts):
                    continue
                hashes, at = window_anchors(data, length, gram)
                at = at[starts]
                held.append(hashes[at[_changes(at) | _changes(own)]])
                count += len(held[-1])
            if count >= 200_000:
                yield flush()
                count = 0
        if held:
            yield flush()

    return run


# -- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix from 1) of at most ``SHARD`` bytes, the last of which isn't 0.

    Larsson and Sadakane: suffixes that agree in h bytes form a group, and a group is sorted by the
    ranks of what follows the h bytes; groups of one are done.  Group, rank and position are packed in
    63 bits and sorted as one number.
    """
    n, bits = len(text), U64(21)
    low = (U64(1) << bits) - U64(1)
    padded = np.concatenate([text, np.zeros(FIRST, np.uint8)])
    packed = np.arange(n, dtype=U64)
    for j in range(FIRST):
        packed |= padded[j : j + n].astype(U64) << U64(21 + 8 * (FIRST - 1 - j))
    packed.sort()
    sa, groups = (packed & low).astype(np.int32), packed >> bits
    rank = np.zeros(n + 1, np.int32)

    def ranked(slots: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks the suffixes ``at`` of ``slots`` by their group's first slot; the slots of groups of more than one."""
        rank[at] = 1 + slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        return np.flatnonzero(~(new & np.append(new[1:], True)))

    slots = np.arange(n)
    left = slots[ranked(slots, sa, _changes(groups))]
    h = FIRST
    while len(left):
        at = sa[left].astype(np.int64)
        follows = rank[np.minimum(at + h, n)]
        packed = rank[at].astype(U64) << U64(42) | follows.astype(U64) << bits | at.astype(U64)
        packed.sort()
        at, groups = (packed & low).astype(np.int64), packed >> bits
        sa[left] = at
        left = left[ranked(left, at, _changes(groups))]
        h *= 2
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """The bytes, ``cap`` at most, that each suffix (by slot) shares with the one before it.

    Kasai: the suffix that starts one later shares at least one byte less with its neighbour.  ``LANES``
    stretches of the text are walked side by side, comparing eight bytes at a time.
    """
    n = len(sa)
    if not n:
        return np.zeros(0, np.int32)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    words = np.zeros(n + cap + 8, U64)
    for r in range(8):
        found = padded[r:][: (len(padded) - r) // 8 * 8].view("<u8")
        words[r::8] = found[: len(words[r::8])]
    steps = -(-n // LANES)
    first = np.arange(0, n, steps)
    shared, h = np.zeros(n, np.int32), np.zeros(len(first), np.int64)
    for t in range(steps):
        i = first + t
        if i[-1] >= n:
            first, h = first[:-1], h[:-1]
            i = i[:-1]
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(h - 1, 0))
        live = np.flatnonzero((j >= 0) & (h < cap))
        while len(live):
            differ = words[i[live] + h[live]] ^ words[j[live] + h[live]]
            same = differ == 0
            # Of words that differ, the lowest set bit tells how many bytes are the same.
            h[live] += np.where(same, 8, np.bitwise_count((differ & (~differ + U64(1))) - U64(1)) >> 3)
            live = live[same]
            live = live[h[live] < cap]
        # Beyond the end of the text nothing is shared.
        h = np.minimum(h, np.minimum(cap, n - np.maximum(i, j)))
        shared[i] = h
    return shared[sa]


# -- shards -----------------------------------------------------------------------------------------------------------


def _small_ints(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _ROW)


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _span_rows(keys: np.ndarray, place: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
    """Rows of runs of consecutive windows, for the groups of their documents."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(keys)))
    for p, at in _split(_dealt(keys[first].view(U64), len(groups)), len(groups)):
        yield int(groups[p]), SPANS, b"", b"", _small_ints(many[at], np.int64), keys[first[at]].tobytes(), _small_ints(place[first[at]], np.int64), b""


class _Shard:
    """Regions of windows whose anchors occur more than once, up to ``SHARD`` bytes."""

    def __init__(self, length: int):
        self.length, self.size, self.regions = length, 0, []

    def add(self, text: np.ndarray, key: int, place: int, anchors: np.ndarray, at: np.ndarray) -> None:
        """A region: its bytes, the place of its first window, and the hash and place (in the bytes) of each window's anchor."""
        self.regions.append((text, key, place, anchors, at))
        self.size += len(text) + 1

    def rows(self, ranges: np.ndarray, groups: np.ndarray, frequent: np.ndarray) -> list[tuple]:
        length, end = self.length, np.array([SENTINEL], np.uint8)
        text = np.concatenate([x for r in self.regions for x in (r[0], end)])
        sizes = np.array([len(r[0]) + 1 for r in self.regions])
        stop = np.cumsum(sizes)
        base, windows = stop - sizes, sizes - length
        starts = ragged(base, windows)
        own = np.repeat(np.arange(len(sizes)), windows)
        keys, place = np.array([r[1] for r in self.regions], np.int64)[own], np.array([r[2] for r in self.regions])[own] + starts - base[own]
        anchors, at = np.concatenate([r[3] for r in self.regions]), base[own] + np.concatenate([r[4] for r in self.regions])
        self.size, self.regions = 0, []

        sa, rank = suffix_array(text)
        long = common_prefixes(text, sa, length) >= length
        slot = rank[starts] - 1
        first = ~long[slot]
        again = ~first | np.append(long, False)[slot + 1]
        rows = list(_span_rows(keys[again], place[again], groups))

        often = np.isin(anchors, frequent)
        if (hot := np.flatnonzero(first & often)).size:
            rows += self._window_rows(text, starts[hot], keys[hot], place[hot], ranges)
        some = np.flatnonzero(first & ~often)
        if not len(some):
            return rows
        # Runs of windows, one after the other, round one anchor.
        new = _changes(at[some])
        new[1:] |= np.diff(starts[some]) != 1
        head = some[new]
        many = np.diff(np.append(np.flatnonzero(new), len(some)))
        for p, k in _split(_dealt(anchors[head], len(ranges)), len(ranges)):
            # In the order of the suffixes at the anchors.
            k = k[np.lexsort((rank[at[head[k]]], anchors[head[k]]))]
            h, n = head[k], many[k]
            # All bytes from the first window to ``length`` bytes after the anchor; beyond the region, sentinels as in the shard.
            sizes = at[h] - starts[h] + length
            places = ragged(starts[h], sizes)
            cut = np.where(places < np.repeat(stop[own[h]], sizes), text[np.minimum(places, len(text) - 1)], np.uint8(SENTINEL))
            rows.append((int(ranges[p]), PIECES, anchors[h].tobytes(), _small_ints(at[h] - starts[h], np.int32), _small_ints(n, np.int32), keys[h].tobytes(), _small_ints(place[h], np.int64), cut.tobytes()))
        return rows

    def _window_rows(self, text, starts, keys, place, ranges) -> Iterator[tuple]:
        one, other = (gram_hashes(text, self.length, seed)[starts] for seed in (11, 13))
        for p, k in _split(_dealt(one, len(ranges)), len(ranges)):
            k = k[np.lexsort((other[k], one[k]))]
            yield int(ranges[p]), WINDOWS, one[k].tobytes(), other[k].tobytes(), b"", keys[k].tobytes(), _small_ints(place[k], np.int64), b""


def _sort_shards(length: int, gram: int, bits, frequent, ranges: np.ndarray, groups: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(length)
        for batch in batches:
            row_keys = np.asarray(batch.column(0))
            for data, starts, own, place in _pieces(text_column(batch.column(1)), length):
                if not len(starts):
                    continue
                hashes, at = window_anchors(data, length, gram)
                at = at[starts]
                heads = np.flatnonzero(_changes(at))
                maybe = among(bits.value, hashes[at[heads]].view(np.int64))
                wanted = np.flatnonzero(np.repeat(maybe, np.diff(np.append(heads, len(at)))))
                new = _changes(own[wanted])
                new[1:] |= np.diff(starts[wanted]) != 1
                edges = np.append(np.flatnonzero(new), len(wanted))
                for x, y in zip(wanted[edges[:-1]].tolist(), (wanted[edges[1:] - 1] + 1).tolist()):
                    low, high = int(starts[x]), int(starts[y - 1]) + length
                    if shard.regions and shard.size + high - low + 1 > SHARD:
                        yield _rows(shard.rows(ranges, groups, frequent.value))
                        give_back()
                    shard.add(data[low:high].copy(), int(row_keys[own[x]]), int(place[x]), hashes[at[x:y]], at[x:y] - low)
        if shard.regions:
            yield _rows(shard.rows(ranges, groups, frequent.value))

    return run


# -- merge ------------------------------------------------------------------------------------------------------------


def _ahead(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rows of the ``width`` bytes from each start on."""
    return np.lib.stride_tricks.sliding_window_view(text, width)[starts]


def _behind(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of the ``sizes`` bytes before each start, backwards; zeros after them."""
    padded = np.concatenate([np.zeros(width, np.uint8), text])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts][:, ::-1]
    return np.where(np.arange(width) < sizes[:, None], rows, np.uint8(0))


def _as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1)


def _merged(strings: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The order of all strings, from lists of indices that are sorted already: two by two, each by binary search in the other."""
    while len(lists) > 1:
        out = []
        for a, b in zip(lists[::2], lists[1::2]):
            x, y = (a, b) if len(a) >= len(b) else (b, a)
            at = np.searchsorted(strings[x], strings[y], "right") + np.arange(len(y))
            both, rest = np.empty(len(x) + len(y), np.int64), np.ones(len(x) + len(y), bool)
            both[at] = y
            rest[at] = False
            both[rest] = x
            out.append(both)
        lists = out + lists[len(lists) // 2 * 2 :]
    return lists[0]


def _neighbours(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bytes that each row shares with the one before it in the order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        at = np.arange(lo, min(lo + 4096, len(order)))
        differ = rows[order[at]] != rows[order[at - 1]]
        out[at] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _shared_windows(group: list, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of the windows of one range that stand in several rows."""
    anchors, before, many, keys, place, text = ([np.frombuffer(getattr(r, c), kind) for r in group] for c, kind in (("a", ">u8"), ("b", np.int32), ("c", np.int32), ("keys", np.int64), ("place", np.int64), ("text", np.uint8)))
    ends = np.cumsum([len(a) for a in anchors])
    lists = [np.arange(e - len(a), e) for a, e in zip(anchors, ends)]
    before, many, keys, place = (np.concatenate(x).astype(np.int64) for x in (before, many, keys, place))
    anchors, text = np.concatenate([a.view("<u8") for a in anchors]), np.concatenate(text)
    sizes = before + length
    at = np.cumsum(sizes) - length
    # Suffixes at the anchors, after the anchor's hash; the bytes before, backwards.
    right = np.concatenate([anchors.astype(">u8").view(np.uint8).reshape(-1, 8), _ahead(text, at, length)], 1)
    left = _behind(text, at, before, length - gram)
    strings = _as_strings(right)
    order = _merged(strings, lists)
    common = _neighbours(right, order)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    order_left = np.argsort(_as_strings(left), kind="stable")
    common_left = _neighbours(left, order_left)
    rank_left = np.empty(len(order), np.int64)
    rank_left[order_left] = np.arange(len(order))
    edges = np.concatenate([[0], np.cumsum(many)])
    found = np.zeros(edges[-1], bool)
    for offset in range(int(max(before.max(), 0)) + 1):
        which = np.flatnonzero((before >= offset) & (before - many < offset))
        if len(which) < 2:
            continue
        classes = np.cumsum(common < 8 + length - offset)[rank[which]] * (len(order) + 1) + np.cumsum(common_left < offset)[rank_left[which]]
        by = np.argsort(classes, kind="stable")
        same = classes[by][1:] == classes[by][:-1]
        again = np.zeros(len(which), bool)
        again[by[1:]] |= same
        again[by[:-1]] |= same
        which = which[again]
        found[edges[which] + before[which] - offset] = True
    hit = np.flatnonzero(found)
    own = np.searchsorted(edges, hit, "right") - 1
    return keys[own], place[own] + hit - edges[own]


def _equal_windows(group: list) -> tuple[np.ndarray, np.ndarray]:
    one, other, keys, place = (np.concatenate([np.frombuffer(getattr(r, c), kind) for r in group]) for c, kind in (("a", U64), ("b", U64), ("keys", np.int64), ("place", np.int64)))
    order = np.lexsort((other, one))
    same = (one[order][1:] == one[order][:-1]) & (other[order][1:] == other[order][:-1])
    again = np.zeros(len(one), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return keys[again], place[again]


def _merge(length: int, gram: int, groups: np.ndarray):
    """Of one range, the windows that several shards have; spans of documents pass."""

    @settled
    def run(group: pd.DataFrame) -> pd.DataFrame:
        by_kind: dict[int, list] = {}
        for row in group.itertuples():
            by_kind.setdefault(row.kind, []).append(row)
        if SPANS in by_kind:
            return group[["part", "c", "keys", "place"]]
        found = []
        if len(by_kind.get(PIECES, [])) > 1:
            found.append(_shared_windows(by_kind[PIECES], length, gram))
        if len(by_kind.get(WINDOWS, [])) > 1:
            found.append(_equal_windows(by_kind[WINDOWS]))
        out = []
        for keys, place in found:
            order = np.lexsort((place, keys))
            out += [(r[0], r[4], r[5], r[6]) for r in _span_rows(keys[order], place[order], groups)]
        return pd.DataFrame(out, columns=["part", "c", "keys", "place"])

    return run


def _intervals(length: int):
    """Per document the maximal removed intervals [start, end) of bytes."""

    @settled
    def run(group: pd.DataFrame) -> pd.DataFrame:
        many, keys, place = (np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("c", "keys", "place"))
        order = np.lexsort((place, keys))
        k, start = keys[order], place[order]
        end = start + many[order] + length - 1
        # Ends grow inside a document once each is the greatest so far.
        doc = np.cumsum(_changes(k))
        end = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
        new = _changes(k)
        new[1:] |= start[1:] > end[:-1]
        first = np.flatnonzero(new)
        edges = np.stack([start[first], end[np.append(first[1:], len(k)) - 1]], 1)
        heads = np.flatnonzero(_changes(k[first]))
        bounds = np.append(heads, len(first))
        return pd.DataFrame({"key": k[first][heads], "removed": [edges[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, removed): per document with repeated windows its intervals [start, end) of bytes as int64 pairs."""
    spark, gram = docs.sparkSession, max(1, min(GRAM, length // 2))
    parts = int(max(2 * partitions(spark), planned_bytes(docs) // BUCKET_BYTES))
    dealt = even_keys(spark, 2 * parts)
    ranges, groups = dealt[: len(dealt) // 2], dealt[len(dealt) // 2 :]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    counts = stored(keyed.select("text").mapInArrow(_anchor_counts(length, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "suffix-anchors")
    least = max(FREQUENT, (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT_SHARE)
    # At most FREQUENT_SHARE anchors have that many.
    frequent = np.array([r.anchor for r in counts.where(F.col("n") >= least).select("anchor").toLocalIterator()], np.int64).view(U64)
    sorted_rows = keyed.mapInArrow(_sort_shards(length, gram, sent_filter(counts.select("anchor")), send(spark, frequent), ranges, groups), ROW)
    merged = sorted_rows.groupBy("part").applyInPandas(_merge(length, gram, groups), "part int, c binary, keys binary, place binary")
    return merged.groupBy("part").applyInPandas(_intervals(length), "key long, removed binary")


# -- results ----------------------------------------------------------------------------------------------------------


def _kept(report: bool, text_at: int, outside=None):
    """Rows with their removed bytes, as a report or as rows with what is left; see ``substring_dedup._with_spans``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if outside is not None:
                batch = batch.filter(pa.array(~among(outside.value, np.asarray(batch.column(batch.num_columns - 1)))))
                spans = [None] * batch.num_rows
            else:
                spans = batch.column(batch.num_columns - 1).to_pylist()
            old = batch.column(text_at)
            data, offsets = buffers(text_column(old))
            sizes, removed, many, out = np.diff(offsets), [], [], []
            for i, found in enumerate(spans):
                whole = data[offsets[i] : offsets[i + 1]]
                edges = np.frombuffer(found, np.int64).reshape(-1, 2).tolist() if found else []
                kept, at = [], 0
                for a, b in edges:
                    kept.append(whole[at:a].tobytes())
                    at = b
                kept = b"".join([*kept, whole[at:].tobytes()])
                removed.append(len(whole) - len(kept)), many.append(len(edges))
                out.append(hashlib.sha256(kept).hexdigest() if report else (kept.decode(errors="ignore") if edges else None))
            if report:
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                text = pa.array([t if n else o for o, t, n in zip(old.to_pylist(), out, many)], old.type)
                yield pa.RecordBatch.from_arrays([text if i == text_at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    return run


def byte_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(rows, repeated_spans(rows, length), lambda bits: _kept(True, 1, bits), lambda df, run: df.mapInArrow(run, schema))


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all its columns and the texts without their repeated bytes; a character of which only some bytes stay goes as a whole."""
    spans = repeated_spans(docs.select("doc_id", "text"), length)
    return _with_spans(docs, spans, lambda bits: _kept(False, docs.columns.index("text"), bits), lambda df, run: mapped(df, run, docs.columns))


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return byte_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS win FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM h WHERE len(x) >= 400)),
r AS (SELECT doc_id, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
c AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM c),
k AS (SELECT doc_id, string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept, sum(z - a) AS gone, count(*) AS n FROM g JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)
"""
