"""An index of random-projection trees: planes fitted on a bounded sample, every row in a leaf of every tree.

Build: a task per tree gets the sample's rows; each node that holds more than ``leaf`` of them takes two of its rows that differ
(the ones with the smallest and the largest hash) and is split by the plane between them.
The nodes are a table of their own (tree, node, normal, offset), of bounded size: trees * sample / leaf.  Then every row of the
data goes down all trees in one pass, and keeps its leaves; they are also postings (tree, leaf, vec_id).

Search: best first over all trees at once.  A leaf is as far from a query as the farthest plane on the way to it that has the query on its
other side.  The nearest leaves are opened, until they hold ``reach`` rows; how many that must be follows from
the recall measured on a sample of queries, so it is right for any number of rows on a bounded number of leaves.  A query's opened leaves are a bit each.  Queries and rows meet
in pairs of blocks of bounded size, where bits tell the candidates, which are compared exactly: no candidate is a row of a join.

Append: new rows go down the trees as they are and their postings are added; nothing is built again.  The data's
vectors and leaves are written as one folder per append, so an append that runs again overwrites itself.

Defined results: null embeddings are neither indexed nor ask; rows with equal vectors share their leaves, and a node of equal
vectors isn't split, so a leaf may hold any number of rows: blocks are cut by id, not by leaf; ties go by item_id; a row isn't its own neighbour; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.operators import knn
from slotloom.operators.knn import K
from slotloom.sources.tables import even_keys, spread, written

TREES, LEAF, SAMPLE, DEEPEST = 20, 32, 50_000, 60
NODES = "tree int, node long, normal array<double>, offset double"
#: Queries of a block, of a step inside of it, and that are led down the trees at once; rows of a step.
QUERIES, STEP, LED, ROWS = 4096, 512, 64, 4096
NO_LABEL = np.iinfo(np.int64).min


class _Trees:
    """The nodes of all trees in memory: the children of node n are 2n and 2n + 1, the root is 1; what has no plane is a leaf."""

    def __init__(self, rows: list, trees: int):
        self.trees = trees
        self.at = {(r.tree, r.node): i for i, r in enumerate(rows)}
        self.normals = np.array([r.normal for r in rows], np.float64)
        self.offsets = np.array([r.offset for r in rows], np.float64)
        level = [(tree, 1) for tree in range(trees)]
        nodes, first, self.levels = list(level), 0, []
        while split := [(i, key) for i, key in enumerate(level, first) if key in self.at]:
            first = len(nodes)
            self.levels.append((np.array([i for i, _ in split]), np.array([self.at[key] for _, key in split]), first))
            level = [(tree, 2 * node + side) for side in (0, 1) for _, (tree, node) in split]
            nodes += level
        #: The leaves as (tree, node), in order, and where they are among all nodes.
        ends = sorted((key, i) for i, key in enumerate(nodes) if key not in self.at)
        self.ends, self.at_end = [key for key, _ in ends], np.array([i for _, i in ends], np.int64)
        self.nodes = len(nodes)
        self.of_tree = [np.array([node for t, node in self.ends if t == tree], np.int64) for tree in range(trees)]

    def numbers(self, leaves: np.ndarray) -> np.ndarray:
        """The places in ``ends`` of rows' leaves, a column per tree."""
        first = np.cumsum([0, *map(len, self.of_tree)])
        return np.stack([first[t] + np.searchsorted(self.of_tree[t], leaves[:, t]) for t in range(self.trees)], 1)

    def nearest_ends(self, vectors: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves of each vector from near to far, by their places in ``ends``, and the rows in those before each."""
        far = np.zeros((len(vectors), self.nodes))
        margins = vectors @ self.normals.T - self.offsets if len(self.offsets) else np.zeros((len(vectors), 0))
        for parents, planes, first in self.levels:
            way, margin, n = far[:, parents], margins[:, planes], len(parents)
            # The way to a side leads over the farthest plane on it.
            far[:, first : first + n], far[:, first + n : first + 2 * n] = np.maximum(way, margin), np.maximum(way, -margin)
        order = np.argsort(far[:, self.at_end], axis=1, kind="stable")
        return order, np.cumsum(held[order], axis=1) - held[order]

    def opened_ends(self, vectors: np.ndarray, held: np.ndarray, reach: int) -> np.ndarray:
        """Whether each leaf is opened by each vector.

        Where they would be all leaves, those of one tree are: they hold every row already.
        """
        if reach >= held.sum():
            return np.tile(np.arange(len(held)) < len(self.of_tree[0]), (len(vectors), 1))
        order, before = self.nearest_ends(vectors, held)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < reach, 1)
        return out

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        out = np.ones((len(vectors), self.trees), np.int64)
        if not len(self.offsets):
            return out
        for tree in range(self.trees):
            waiting = [(1, np.arange(len(vectors)))]
            while waiting:
                node, rows = waiting.pop()
                plane = self.at.get((tree, node))
                if plane is None:
                    out[rows, tree] = node
                    continue
                right = vectors[rows] @ self.normals[plane] > self.offsets[plane]
                for child, some in ((2 * node, rows[~right]), (2 * node + 1, rows[right])):
                    if len(some):
                        waiting.append((child, some))
        return out

    def opened(self, vector: np.ndarray, sizes: dict, reach: int) -> list[tuple[int, int]]:
        """The leaves (tree, node) that a vector opens, until they hold ``reach`` rows."""
        held = np.array([sizes.get(key, 0) for key in self.ends], np.int64)
        return [self.ends[i] for i in np.flatnonzero(self.opened_ends(np.asarray(vector, np.float64)[None, :], held, reach)[0])]


def _hashed(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers that look drawn, for ids and a node's level, tree and seed."""
    h = ids.astype(np.uint64)
    for x in salt:
        h = (h ^ np.uint64(x & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _planes(sample: DataFrame, trees: int, leaf: int, seed: int) -> DataFrame:
    """The nodes: a task per tree splits the rows of the sample, which is bounded."""

    def fit(rows: pa.Table) -> pa.Table:
        tree, ids = rows["tree"][0].as_py(), rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], knn._matrix(rows["embedding"])[order]
        out, waiting = [], [(1, np.arange(len(ids)), 0)]
        while waiting:
            node, some, level = waiting.pop()
            if len(some) <= leaf or level > DEEPEST:
                continue
            x, h = vectors[some], _hashed(ids[some], tree, seed, level)
            a = x[h.argmin()]
            differ = np.flatnonzero((x != a).any(1))
            # Equal rows make no plane: the node stays a leaf.
            if not len(differ):
                continue
            b = x[differ[h[differ].argmax()]]
            normal = b - a
            offset = float(normal @ ((a + b) / 2))
            right = x @ normal > offset
            if right.all() or not right.any():
                continue
            out.append((tree, node, normal, offset))
            waiting += [(2 * node, some[~right], level + 1), (2 * node + 1, some[right], level + 1)]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(list(columns[2]), pa.list_(pa.float64())), pa.array(columns[3], pa.float64())], ["tree", "node", "normal", "offset"])

    each = sample.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return each.repartition(2 * trees, "tree").groupBy("tree").applyInArrow(fit, NODES)


class Forest:
    """Planes, the rows (vec_id, embedding, label, leaves) and their postings (tree, leaf, vec_id)."""

    def __init__(self, spark: SparkSession, path: str):
        """The index that lies in a folder."""
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        self.trees = meta.trees
        self.nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
        self.rows = spark.read.parquet(f"{path}/rows")
        self.postings = self.rows.select(F.posexplode("leaves").alias("tree", "leaf"), "vec_id")

    @classmethod
    def build(cls, rows: DataFrame, path: str, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 0) -> Forest:
        """Fits the planes on the ``sample`` rows with the smallest hash of vec_id, and indexes every row in a folder."""
        spark = rows.sparkSession
        known = rows.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        picked = written(known.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample), "forest-sample")
        written(_planes(picked, trees, leaf, seed), "forest-nodes").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(trees, leaf, sample, seed)], "trees int, leaf int, sample int, seed long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return cls._added(rows, path, 0)

    @classmethod
    def _added(cls, rows: DataFrame, path: str, epoch: int) -> Forest:
        spark = rows.sparkSession
        data = rows.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").collect()
        trees = _Trees(nodes, spark.read.parquet(f"{path}/meta").first().trees)
        sent = spark.sparkContext.broadcast(trees)

        @F.pandas_udf("array<long>")
        def leaves(v: pd.Series) -> pd.Series:
            return pd.Series(list(sent.value.leaves(np.array(v.tolist(), np.float64))) if len(v) else [])

        spread(data, "vec_id").withColumn("leaves", leaves("embedding")).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        return cls(spark, path)

    def append(self, rows: DataFrame, epoch: int) -> Forest:
        """The index with more rows, as epoch 1, 2, ...; a repeated epoch replaces what it added before."""
        if epoch < 1:
            raise ValueError("epoch 0 is what the index was built from")
        return self._added(rows, self.path, epoch)

    def _held(self) -> tuple[_Trees, np.ndarray]:
        """The trees, and the rows of each leaf; a row per leaf, as many as nodes."""
        trees = _Trees(self.nodes.collect(), self.trees)
        sizes = {(r.tree, r.leaf): r.n for r in self.postings.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        return trees, np.array([sizes.get(key, 0) for key in trees.ends], np.int64)

    def reach_for(self, queries: DataFrame, k: int = K, recall: float = 0.95, sample: int = 200) -> int:
        """The least reach that meets ``recall`` of the true neighbours of the ``sample`` queries (vec_id, embedding) with the smallest hash."""
        return self._reach(*self._held(), queries, k, recall, sample)

    def _reach(self, trees: _Trees, held: np.ndarray, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 200) -> int:
        picked = queries.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample).select("vec_id", "embedding").collect()
        asked = self.spark.createDataFrame(picked, queries.select("vec_id", "embedding").schema)
        true = knn.nearest(asked, self.rows, k).select("query_id", "item_id")
        found = {}
        for r in true.join(self.rows.select(F.col("vec_id").alias("item_id"), "leaves"), "item_id").collect():
            found.setdefault(r.query_id, []).append(r.leaves)
        needed = []
        for r in picked:
            if r.vec_id in found:
                order, before = trees.nearest_ends(np.array([r.embedding], np.float64), held)
                by_end = np.empty(len(held), np.int64)
                by_end[order[0]] = before[0]
                needed.append(by_end[trees.numbers(np.array(found[r.vec_id], np.int64))].min(1) + 1)
        if not needed:
            return 1
        needed = np.sort(np.concatenate(needed))
        return int(needed[math.ceil(recall * len(needed)) - 1])

    def search(self, queries: DataFrame, k: int = K, reach: int | None = None) -> DataFrame:
        """(query_id, item_id, label, dist, rn) among the candidates of each query (vec_id, embedding).

        ``reach``: rows in the opened leaves of a query, counted once per tree; by default that of ``reach_for``, and 10 * k per tree at least.
        """
        trees, held = self._held()
        if reach is None:
            reach = max(10 * k * self.trees, self._reach(trees, held, queries, k))
        queries = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
        sent = self.spark.sparkContext.broadcast((trees, held))

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, held = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, LED):
                    some = batch.slice(at, LED)
                    bits = np.packbits(trees.opened_ends(knn._matrix(some.column("query")), held, reach), axis=1)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([row.tobytes() for row in bits], pa.binary())], ["query_id", "query", "opened"])

        asked = written(queries.mapInArrow(opened, "query_id long, query array<double>, opened binary"), "forest-asked")
        n, cores = asked.count(), self.spark.sparkContext.defaultParallelism
        size = max(1, knn.BLOCK_VALUES // max(1, trees.trees + (trees.normals.shape[1] if len(trees.offsets) else 1)))
        of_queries = max(1, math.ceil(n / QUERIES))
        of_rows = max(1, math.ceil(int(held.sum()) / trees.trees / size), math.ceil(2 * cores / of_queries))
        part = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        tasks = of_rows * of_queries
        group = F.get(F.lit(even_keys(self.spark, tasks)), F.col("r") * of_queries + F.col("q")).alias("group")
        rows = self.rows.select(part("vec_id", of_rows).alias("r"), every(of_queries).alias("q"), F.col("vec_id").alias("item_id"), "embedding", "label", "leaves").select(group, "item_id", "embedding", "label", "leaves")
        asked = asked.select(part("query_id", of_queries).alias("q"), every(of_rows).alias("r"), "query_id", "query", "opened").select(group, "query_id", "query", "opened")

        def meet(theirs: pa.Table, ours: pa.Table) -> pa.Table:
            parts = [pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.float64())], ["query_id", "item_id", "label", "dist"])]
            if not theirs.num_rows or not ours.num_rows:
                return parts[0]
            trees, held = sent.value
            items, vectors, labels = ours["item_id"].to_numpy(), knn._matrix(ours["embedding"]), ours["label"].cast(pa.int64()).fill_null(NO_LABEL).to_numpy()
            ends = trees.numbers(np.asarray(ours["leaves"].combine_chunks().flatten(), np.int64).reshape(len(items), -1))
            for at in range(0, theirs.num_rows, STEP):
                some = theirs.slice(at, STEP)
                # For each leaf the queries that open it, a bit each: a row is a candidate of those of all its leaves.
                by_query = np.stack([np.unpackbits(np.frombuffer(bits, np.uint8), count=len(held)) for bits in some["opened"].to_pylist()])
                by_end = np.packbits(by_query.T, axis=1)
                best = knn._Best(some["query_id"].to_numpy(), knn._matrix(some["query"]), k)
                for lo in range(0, len(items), ROWS):
                    met = by_end[ends[lo : lo + ROWS, 0]]
                    for tree in range(1, trees.trees):
                        met |= by_end[ends[lo : lo + ROWS, tree]]
                    pairs = np.unpackbits(met, axis=1, count=some.num_rows).T.astype(bool)
                    best.add(items[lo : lo + ROWS], vectors[lo : lo + ROWS], labels[lo : lo + ROWS], pairs=pairs)
                best.done()
                known = best.label != NO_LABEL
                parts.append(pa.table([best.ids[best.q], best.item, pa.array(np.where(known, best.label, 0).astype(np.int32), mask=~known), best.d], ["query_id", "item_id", "label", "dist"]))
            return pa.concat_tables(parts)

        met = asked.repartition(tasks, "group").groupBy("group").cogroup(rows.repartition(tasks, "group").groupBy("group")).applyInArrow(meet, "query_id long, item_id long, label int, dist double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "item_id"))
        return met.withColumn("rn", rank).where(F.col("rn") <= k)
