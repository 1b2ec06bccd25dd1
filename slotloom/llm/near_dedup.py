"""MinHash near-deduplication by a signature-coordinate inverted join.

1. Every document becomes its set of hashed word shingles and a signature of
   ``COORDINATES`` minima.  Documents with equal sets form a class; all later
   steps see one row per class.
2. Classes are posted under each (coordinate, value) pair.  Values are ordered by
   how many classes hold them.  Two classes that agree on ``matches`` of
   ``COORDINATES`` coordinates share one of the ``COORDINATES - matches + 1``
   rarest values of each (the prefix), so classes with fewer than ``matches``
   shared values drop out (skip) and only prefixes are joined.
3. Classes that share a prefix value, directly or over others, form a group.
   Inside a group agreeing coordinates are counted for pairs, pairs below the
   match threshold go, and the rest are confirmed on full shingle sets, best
   agreement first; a pair that is already connected is skipped (merging).
   Large groups are cut into blocks: each block meets itself and a few pivots.
   Then classes outside of the group's main component meet all of it, in blocks of
   signatures first; only those with an agreeing partner in a block meet it with their
   texts.  A task gives a spanning forest, never all pairs.
4. The components of these links are the result.

``matches`` follows from the similarity: a pair that is just similar enough agrees on
fewer coordinates with a probability of at most ``MISSED`` (42 of 64 for 0.85, 37 for
0.80); more similar pairs with much less.  Hot values
(held by more than 1/``HOT_SHARE`` of the classes, at most
``COORDINATES * HOT_SHARE`` of them) are the only ones that are broadcast; their
postings are counted by blocks and never brought together in a task.  The order of
values only has to be the same everywhere, so a count of a hot value leaves out the
blocks in which it occurs once.

Defined results: null texts and texts without words have an empty set and are
linked with nothing; a text with fewer words than a shingle is one shingle;
repeated rows are copies of each other and of equal doc_ids all rows share
``kept``; ``drop_near_duplicates`` keeps one row of each component; a null doc_id never is
the smallest; an empty table gives no rows; extra columns are ignored or pass through,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.graph import components
from slotloom.llm.keyfilter import likely, outside, sent_filter
from slotloom.llm.shared import even_keys, partitions, planned_bytes, quoted, send, stored, unused
from slotloom.llm.words import NON_SPACE, U64, _splitmix, chunks, mix, scan, settled, text_column, tidy, windows, word_hashes

SHINGLE_WORDS = 3
SIMILARITY = (85, 100)
COORDINATES = 64
MISSED = 3e-5
HOT_SHARE, HOT_LEAST = 4000, 500
BLOCK_CLASSES, BLOCK_SHINGLES, PIVOTS = 128, 1_500_000, 6
#: Signatures that meet in a block when loose classes meet their group.
CROSS_CLASSES = 2000

_FACTORS = np.array([_splitmix(7000 + j) | 1 for j in range(COORDINATES)], U64)
_TERMS = np.array([_splitmix(9000 + j) for j in range(COORDINATES)], U64)


def matches(similarity: tuple[int, int]) -> int:
    """The most coordinates that may be asked for, so that a pair at ``similarity`` is missed with ``MISSED`` at most."""
    p, missed = similarity[0] / similarity[1], 0.0
    for k in range(COORDINATES):
        missed += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if missed > MISSED:
            return max(k, 1)
    return COORDINATES


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, one after the other; edges of the documents)."""
    starts, ends, doc = scan(data, offsets, NON_SPACE)
    hashed = word_hashes(data, starts, ends, True)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    at, h = windows(hashed, doc, size)
    of = doc[at]
    for short in range(1, size):
        if (count == short).any():
            at, more = windows(hashed, doc, short)
            whole = count[doc[at]] == short
            h, of = np.concatenate([h, more[whole]]), np.concatenate([of, doc[at][whole]])
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")]
    h, of = h[order], of[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(n_docs + 1))


def signatures(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The minima of each non-empty document under all coordinates' hash functions."""
    first = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(first), COORDINATES), U64)
    if len(first):
        for j in range(COORDINATES):
            out[:, j] = np.minimum.reduceat(shingles * _FACTORS[j] + _TERMS[j], first)
    return out


def _sign(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for _, _, data, offsets in chunks(text_column(batch.column(2))):
                sets, edges = shingle_sets(data, offsets, size)
                rows = iter(signatures(sets, edges))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    n.append(b - a)
                    digest.append(hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    sig.append(next(rows).tobytes() if b > a else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["key", "doc_id", "n_shingles", "digest", "sig"])

    return run


# -- postings ---------------------------------------------------------------------------------------------------------


def _posts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, hashes of their (coordinate, value) pairs as rows)."""
    nodes = np.asarray(batch.column(0))
    sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), U64).reshape(-1, COORDINATES)
    return nodes, mix(sig ^ _TERMS[::-1])


def _by_part(of: np.ndarray, parts: int):
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Blocks of about so many rows, whatever the batches are: few blocks per task keep what a hot value may lose in its count small."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _hot_values(classes: DataFrame, parts: int, least: int) -> dict[int, int]:
    """Values held by more than ``least`` classes, with their counts; there are at most COORDINATES * HOT_SHARE."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            hashes, counts = np.unique(_posts(batch)[1], return_counts=True)
            hashes, counts = hashes[counts > 1], counts[counts > 1]
            rows = [(int(keys[p]), hashes[at].tobytes(), counts[at].astype(np.int32).tobytes()) for p, at in _by_part(_part_of(hashes, parts), parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "hashes", "counts"])

    @settled
    def total(group: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(group["hashes"]), U64)
        counts = np.frombuffer(b"".join(group["counts"]), np.int32).astype(np.int64)
        hashes, which = np.unique(hashes, return_inverse=True)
        counts = np.bincount(which, counts).astype(np.int64)
        many = counts > least
        return pd.DataFrame({"hash": hashes[many].view(np.int64), "n": counts[many]})

    keys = even_keys(classes.sparkSession, parts)
    parts = len(keys)
    counted = classes.select("node", "sig").mapInArrow(count, "part int, hashes binary, counts binary")
    return {r.hash: r.n for r in counted.groupBy("part").applyInPandas(total, "hash long, n long").collect()}


def prefix_postings(classes: DataFrame, least: int) -> DataFrame:
    """(hash, node, hot): the rarest values, as many as the prefix for ``least`` matches needs, of classes with enough shared values."""
    spark = classes.sparkSession
    parts = max(2 * partitions(spark), planned_bytes(classes) // (4 << 20))
    keys = even_keys(spark, 2 * int(parts))
    parts = len(keys) // 2
    # The postings of a range of values have the first half of the keys, those of a group of nodes the second.
    of_nodes = np.sort(keys[parts:])
    many_are = max(HOT_LEAST, classes.count() // HOT_SHARE)
    hot = send(spark, _hot_values(classes, parts, many_are))

    @tidy
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_hashes = np.array(sorted(np.array(list(hot.value), np.int64).view(U64).tolist()), U64)
        hot_counts = np.array([hot.value[h] for h in hot_hashes.view(np.int64).tolist()], np.int64)
        for batch in _blocks(batches):
            nodes, posts = _posts(batch)
            hashes, nodes = posts.reshape(-1), np.repeat(nodes, COORDINATES)
            is_hot = np.zeros(len(hashes), bool)
            if len(hot_hashes):
                place = np.minimum(np.searchsorted(hot_hashes, hashes), len(hot_hashes) - 1)
                is_hot = hot_hashes[place] == hashes
            rows = []
            cold = np.flatnonzero(~is_hot)
            for p, at in _by_part(_part_of(hashes[cold], parts), parts):
                rows.append((int(keys[p]), hashes[cold[at]].tobytes(), nodes[cold[at]].tobytes(), b""))
            warm = np.flatnonzero(is_hot)
            for p, at in _by_part((mix(nodes[warm].view(U64)) % U64(parts)).astype(np.int64), parts):
                at = warm[at]
                rows.append((int(keys[parts + p]), hashes[at].tobytes(), nodes[at].tobytes(), hot_counts[place[at]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), *[pa.binary()] * 3))], ["part", "hashes", "nodes", "counts"])

    @settled
    def share(group: pd.DataFrame) -> pd.DataFrame:
        """Of a range of values those that several classes hold, for their nodes' parts."""
        part = group["part"].iloc[0]
        if of_nodes[min(np.searchsorted(of_nodes, part), len(of_nodes) - 1)] == part:
            return group
        hashes = np.frombuffer(b"".join(group["hashes"]), U64)
        nodes = np.frombuffer(b"".join(group["nodes"]), np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, nodes = hashes[order], nodes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        counts = np.repeat(np.diff(np.append(first, len(hashes))), np.diff(np.append(first, len(hashes)))).astype(np.int64)
        many = np.flatnonzero(counts > 1)
        rows = [(int(keys[parts + p]), hashes[many[at]].tobytes(), nodes[many[at]].tobytes(), counts[many[at]].tobytes()) for p, at in _by_part((mix(nodes[many].view(U64)) % U64(parts)).astype(np.int64), parts)]
        return pd.DataFrame(rows, columns=["part", "hashes", "nodes", "counts"])

    @settled
    def choose(group: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(group["hashes"]), U64)
        nodes = np.frombuffer(b"".join(group["nodes"]), np.int64)
        counts = np.frombuffer(b"".join(group["counts"]), np.int64)
        order = np.lexsort((hashes, counts, nodes))
        hashes, nodes = hashes[order], nodes[order]
        first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        shared = np.diff(np.append(first, len(nodes)))
        rank = np.arange(len(nodes)) - np.repeat(first, shared)
        # The values that nobody shares are the rarest and use up the prefix first.
        keep = rank < np.repeat(shared - least + 1, shared)
        return pd.DataFrame({"hash": hashes[keep].view(np.int64), "node": nodes[keep], "hot": counts[order][keep] > many_are})

    packed = "part int, hashes binary, nodes binary, counts binary"
    posted = classes.select("node", "sig").mapInArrow(post, packed)
    return posted.groupBy("part").applyInPandas(share, packed).groupBy("part").applyInPandas(choose, "hash long, node long, hot boolean")


# -- pairs inside a group ---------------------------------------------------------------------------------------------


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of left with right sets, by products of their incidence matrices."""
    both = np.union1d(left, right)
    place = {int(x): k for k, x in enumerate(both)}
    flat = np.concatenate([sets[i] for i in both])
    row = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.flatnonzero(times[column] > 1)
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    l, r = np.array([place[int(i)] for i in left]), np.array([place[int(i)] for i in right])
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        m = np.zeros((len(both), 4096), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[l] @ m[r].T
    return out.astype(np.int64)


def confirm(sets: list[np.ndarray], sig: np.ndarray, forest: _Forest, left: np.ndarray, right: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> None:
    """Links similar pairs of left x right in the forest, unless they are connected already."""
    (top, of), least = similarity, matches(similarity)
    n = np.array([len(s) for s in sets])
    short = sig.astype(np.uint32)
    found = []
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        same = np.zeros((len(rows), len(right)), np.uint8)
        a, b = short[rows], short[right]
        for j in range(sig.shape[1]):
            same += a[:, j, None] == b[None, :, j]
        ok = (same >= least) & (rows[:, None] != right[None, :]) & (of * np.minimum(n[rows][:, None], n[right][None, :]) >= top * np.maximum(n[rows][:, None], n[right][None, :]))
        i, j = np.nonzero(ok)
        found.append(np.stack([rows[i], right[j], same[i, j]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    pairs = pairs[np.argsort(-pairs[:, 2], kind="stable")]
    failed = 0
    while len(pairs):
        roots = forest.roots()
        pairs = pairs[roots[pairs[:, 0]] != roots[pairs[:, 1]]]
        if failed > 500 and len(pairs) > 2000:
            # Many agreeing pairs that aren't similar enough: exact sizes for all of what is left at once.
            l, r = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
            inter = _intersections(sets, l, r)[np.searchsorted(l, pairs[:, 0]), np.searchsorted(r, pairs[:, 1])]
            good = of * inter >= top * (n[pairs[:, 0]] + n[pairs[:, 1]] - inter)
            for i, j, _ in pairs[good].tolist():
                forest.link(i, j)
            return
        for i, j, _ in pairs[:1024].tolist():
            if forest.root(i) != forest.root(j):
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if of * inter >= top * (n[i] + n[j] - inter):
                    forest.link(i, j)
                else:
                    failed += 1
        pairs = pairs[1024:]


def _group_links(size: int, similarity: tuple[int, int]):
    """Links inside the blocks of a part; ``role`` 1 rows meet all rows of their block, 0 rows only those."""

    @settled
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in part.groupby(["grp", "block"], sort=False):
            if len(g) < 2:
                continue
            g = g.sort_values("role", ascending=False, kind="stable").drop_duplicates("node").reset_index(drop=True)
            sets: list[np.ndarray] = []
            for _, _, data, offsets in chunks(pa.array(g["text"], pa.string())):
                flat, edges = shingle_sets(data, offsets, size)
                sets += [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
            sig = np.frombuffer(b"".join(g["sig"]), U64).reshape(-1, COORDINATES)
            forest = _Forest(len(g))
            labels = g["label"].to_numpy()
            for label in np.unique(labels[labels != 0]):  # connected before
                same = np.flatnonzero(labels == label)
                forest.up[same] = same[0]
            meets = np.flatnonzero(g["role"].to_numpy() == 1)
            every = np.arange(len(g))
            confirm(sets, sig, forest, meets, every, similarity)
            nodes = g["node"].to_numpy()
            out += [(int(nodes[i]), int(nodes[j])) for i, j in forest.edges]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _agreeing(similarity: tuple[int, int]):
    """Of the blocks of a part, by signatures alone: rows that agree enough with a row of another label, of which one has ``role`` 1."""
    (top, of), least = similarity, matches(similarity)

    @settled
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (grp, block), g in part.groupby(["grp", "block"], sort=False):
            sig = np.frombuffer(b"".join(g["sig"]), U64).reshape(-1, COORDINATES).astype(np.uint32)
            n, label, role = g["size"].to_numpy(), g["label"].to_numpy(), g["role"].to_numpy()
            some, meets = np.zeros(len(g), bool), np.flatnonzero(role == 1)
            for at in range(0, len(meets), 128):
                rows = meets[at : at + 128]
                same = np.zeros((len(rows), len(g)), np.uint8)
                for j in range(COORDINATES):
                    same += sig[rows, j, None] == sig[None, :, j]
                ok = (same >= least) & (label[rows, None] != label[None, :]) & (of * np.minimum(n[rows, None], n[None, :]) >= top * np.maximum(n[rows, None], n[None, :]))
                some[rows] |= ok.any(1)
                some |= ok.any(0)
            found = g[some]
            if len(found):
                out.append(pd.DataFrame({"node": found["node"], "grp": grp, "block": block, "role": found["role"], "label": found["label"]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["node", "grp", "block", "role", "label"])

    return run


def links(docs: DataFrame, classes: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): confirmed links between classes (node, rep_key, n, sig) that span all their components."""
    spark = classes.sparkSession
    posts = stored(prefix_postings(classes, matches(similarity)), "posts")
    least = posts.groupBy("hash").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n"), F.bool_or("hot").alias("hot")).where("n > 1").select(F.col("hash").alias("h"), "b", F.col("hot").alias("many"))
    least = stored(least, "least")
    # Hot values are at most COORDINATES * HOT_SHARE: they are broadcast, so the postings of one never come together.
    hot, cold = posts.where("hot").join(F.broadcast(least.where("many")), F.col("hash") == F.col("h")), posts.where("not hot").join(least.where("not many"), F.col("hash") == F.col("h"))
    groups = components(hot.unionByName(cold).select(F.col("node").alias("a"), "b"), "groups")
    # Few classes are in groups: filters keep the other signatures and texts out of the shuffles.
    grouped = likely(classes.select("node", "rep_key", F.col("n").alias("size"), "sig"), sent_filter(groups.select("vertex")))
    members = stored(groups.join(grouped, groups.vertex == grouped.node).select("node", F.col("label").alias("grp"), "rep_key", "size", "sig"), "members")
    # Repeated rows combine before the shuffle.
    texts = likely(docs.select(F.xxhash64("doc_id", "text").alias("text_key"), "text"), sent_filter(members.select("rep_key"))).groupBy("text_key").agg(F.first("text").alias("text"))
    known = members.select("node", "rep_key", "sig")
    texts = stored(known.join(texts, known.rep_key == texts.text_key).select(F.col("node").alias("of"), "sig", "text"), "member-texts")
    blocks = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    large = blocks.select(F.col("grp").alias("g"), F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.ceil(F.greatest(F.col("m") / CROSS_CLASSES, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("crossed"))
    large = stored(large.where("blocks > 1"), "large")
    signed = members.select("node", "grp", "size", "sig")
    members = members.select("node", "grp")
    placed = members.join(large, members.grp == large.g, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.expr("pmod(xxhash64(node, 1), blocks)").cast("int")).drop("g")
    parts = even_keys(spark, int(max(4 * partitions(spark), planned_bytes(texts) // (2 << 20))))
    listed = F.split(F.lit(",".join(map(str, parts))), ",").cast("array<int>")
    # The blocks of a group follow each other, so they are tasks of their own.
    part = F.get(listed, F.expr(f"pmod(pmod(xxhash64(grp), {len(parts)}) + block, {len(parts)})").cast("int")).alias("part")
    run = _group_links(size, similarity)

    def met(rows: DataFrame) -> DataFrame:
        """Links of rows (node, grp, block, role, label)."""
        full = rows.join(texts, rows.node == texts.of).select("node", "grp", "sig", "block", "role", "label", "text", part)
        return full.groupBy("part").applyInPandas(run, "a long, b long")

    columns = ("node", "grp", "block", "role", "label")
    own = placed.select("node", "grp", "block", F.lit(1).alias("role"), F.lit(0).cast("long").alias("label"))
    if not large.take(1):
        return stored(met(own), "links")
    in_large = members.join(large, members.grp == large.g).drop("g")
    picks = in_large.groupBy("grp").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).alias(f"p{i}") for i in range(PIVOTS)])
    picks = picks.select(F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.node") for i in range(PIVOTS)]))).alias("pick"))
    pivots = in_large.join(picks, in_large.node == picks.pick).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "grp", "block", F.lit(1).alias("role"), F.lit(0).cast("long").alias("label"))
    first = stored(met(own.unionByName(pivots)), "links-first")
    # What isn't connected to the main component of its group meets all of the group, by signatures.
    labels = components(first, "blocks")
    labelled = in_large.join(labels, in_large.node == labels.vertex, "left").withColumn("label", F.coalesce("label", "node")).drop("vertex", "blocks")
    labelled = stored(labelled.withColumn("block", F.expr("pmod(xxhash64(node, 1), crossed)").cast("int")), "labelled")
    main = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"))
    main = stored(main.select(F.col("grp").alias("g"), F.col("top.label").alias("main")), "main")
    rest = labelled.join(main, labelled.grp == main.g).where("label <> main")
    loose = stored(rest.drop("g", "main"), "loose")
    if not loose.take(1):
        return first
    loose_blocks = stored(loose.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / CROSS_CLASSES).cast("int").alias("rb")).select(F.col("grp").alias("g"), "rb"), "loose-blocks")
    # A task is a block of the group with a block of the loose classes: block number * loose blocks + loose block.
    theirs = loose.join(loose_blocks, loose.grp == loose_blocks.g).withColumn("r", F.expr("pmod(xxhash64(node, 2), rb)").cast("int"))
    theirs = theirs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("crossed") - 1))).withColumn("block", (F.col("o") * F.col("rb") + F.col("r")).cast("int")).withColumn("role", F.lit(1)).select(*columns)
    ours = labelled.join(loose_blocks, labelled.grp == loose_blocks.g).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
    ours = ours.withColumn("block", (F.col("block") * F.col("rb") + F.col("r")).cast("int")).withColumn("role", F.lit(0)).select(*columns)
    both = theirs.unionByName(ours).join(signed.select(F.col("node").alias("of"), "size", "sig"), F.col("node") == F.col("of")).select(*columns, "size", "sig", part)
    agreeing = stored(both.groupBy("part").applyInPandas(_agreeing(similarity), "node long, grp long, block int, role int, label long"), "agreeing")
    return stored(first.unionByName(met(agreeing)), "links")


# -- the operator -----------------------------------------------------------------------------------------------------


def _labelled(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """key, doc_id, n_shingles, component_id, kept of every row."""
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    signed = stored(keyed.mapInArrow(_sign(size), f"key long, doc_id {kind}, n_shingles long, digest binary, sig binary"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("rep_key"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = stored(classes.select(F.xxhash64("digest").alias("node"), "digest", "first_id", "rep_key", "n", "sig"), "classes")
    found = components(links(rows, classes.select("node", "rep_key", "n", "sig"), size, similarity), "components")
    ids = found.join(classes.select("node", "first_id"), found.vertex == classes.node).select("vertex", "label", "first_id")
    least = ids.groupBy("label").agg(F.min("first_id").alias("least")).select(F.col("label").alias("l"), "least")
    joined = stored(ids.join(least, ids.label == least.l).select("vertex", "least"), "least-ids")
    of = classes.join(joined, classes.node == joined.vertex, "left").select(F.col("digest").alias("d"), F.coalesce("least", "first_id").alias("component"))
    of = stored(of, "class-ids")
    out = signed.select("key", "doc_id", "n_shingles", "digest").join(of, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("key", "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of every row of ``docs`` (doc_id, text)."""
    return _labelled(docs, size, similarity).drop("key")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    A component's document stands for it: rows with the doc_id of that document and another text of
    the component stay too, but of rows with the same doc_id and text one stays.
    """
    own, key, stays, row = unused(docs.columns, "own", "key", "stays", "row")
    found = _labelled(docs, size, similarity).groupBy("key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
    # Rows that go, or of which one goes, are few: a filter keeps all other texts where they are.
    touched = stored(found.where("not kept or (n > 1 and n_shingles > 0)").select(F.col("key").alias(key), F.col("kept").alias(stays)), "touched")
    bits = sent_filter(touched.select(key))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias(own), *quoted(docs.columns))
    met = likely(keyed, bits).join(touched, F.col(own) == F.col(key), "left")
    again = met.where(F.col(stays)).groupBy(own).agg(F.first(F.struct(*quoted(docs.columns))).alias(row)).select(f"{row}.*")
    return outside(keyed, bits).drop(own).unionByName(met.where(F.col(key).isNull()).select(*quoted(docs.columns))).unionByName(again)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.least, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id
"""
