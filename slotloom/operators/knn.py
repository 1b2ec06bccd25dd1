"""Nearest labelled neighbours and the weighted vote.

Exact search takes a stated set of queries against all rows, in blocks: a block of
at most ``BLOCK_QUERIES`` queries is sent to the executors, every partition of the
rows gives each query its k nearest, and the k best of those are kept.  Only k rows
per partition and query are shuffled.

The index is an inverted file: centroids, about the square root of the rows in number,
are fitted on a bounded sample, every row is assigned to its nearest centroid, and any
number of queries meet the rows of their nearest cells in blocks of bounded size, each of
which gives the k nearest of its rows only.  How many cells are probed follows from the
recall measured on a sample of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, BLOCK_QUERIES = 10, 4096
EPSILON = 1e-10
SAMPLE_ROWS, LEAST_CELLS, ROWS_PER_CELL = 50_000, 16, 8
#: Vector components of the rows, and of the queries, that meet in one block.
BLOCK_VALUES = 4_000_000
#: A share of pairs below which they are compared one by one.
FEW = 0.02


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class _Best:
    """The k nearest rows of each query so far; with ``most``, those only that lie within a distance known for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, most: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = (vectors * vectors).sum(1)
        # A product with (row, 1, its norm) is a squared distance.
        self.left = np.concatenate([-2 * vectors, self.norms[:, None], np.ones((len(ids), 1))], 1)
        self.most = np.full(len(ids), np.inf) if most is None else np.array(most, np.float64)
        empty = np.zeros(0, np.int64)
        self.q, self.d, self.item, self.label = empty, np.zeros(0), empty, empty
        self.waiting: list[tuple] = []

    def add(self, row_ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, some: np.ndarray | None = None, pairs: np.ndarray | None = None) -> None:
        """Rows that the queries meet, or ``some`` of them by their numbers; of all their ``pairs``, or of those that are true."""
        some = np.arange(len(self.ids)) if some is None else some
        if not len(rows) or not len(some):
            return
        if pairs is not None and np.count_nonzero(pairs) < FEW * pairs.size:
            q, c = np.nonzero(pairs)
            self._look(some[q], c, row_ids, rows, labels)
            return
        norms = (rows * rows).sum(1)
        approx = (self.left if len(some) == len(self.ids) else self.left[some]) @ np.concatenate([rows, np.ones((len(rows), 1)), norms[:, None]], 1).T
        # Every row that may be among the k nearest: up to the k-th distance so far, or the fast one of the k-th other row here, and its rounding. Exact distance and id decide.
        margin = 8 * np.finfo(float).eps * (rows.shape[1] + 8) * (np.sqrt(self.norms[some]) + np.sqrt(norms.max())) ** 2
        bound = self.most[some] ** 2 + margin
        if pairs is not None:
            approx[~pairs] = np.inf
        free = np.flatnonzero(np.isinf(bound))
        if len(free) and self.k < len(rows):
            bound[free] = np.partition(approx[free], self.k, axis=1)[:, self.k] + margin[free]
        near = approx <= bound[:, None]
        q, c = np.divmod(np.flatnonzero(near if pairs is None else near & pairs), len(rows))
        self._look(some[q], c, row_ids, rows, labels, bool(len(free)))

    def _look(self, q: np.ndarray, c: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, now: bool = False) -> None:
        q, c = q[other := self.ids[q] != row_ids[c]], c[other]
        for at in range(0, len(q), 65_536):
            x, y = q[at : at + 65_536], c[at : at + 65_536]
            d = np.sqrt(((rows[y] - self.vectors[x]) ** 2).sum(1))
            self.waiting.append((x, d, row_ids[y], labels[y]))
            if now or sum(len(w[0]) for w in self.waiting) >= self.k * len(self.ids):
                self.done()

    def done(self) -> _Best:
        """What waits is ranked; the k-th distances are bounds from now on."""
        q, d, item, label = (np.concatenate(parts) for parts in zip((self.q, self.d, self.item, self.label), *self.waiting))
        self.waiting = []
        order = np.lexsort((item, d, q))
        q = q[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = order[rank < self.k]
        last = rank == self.k - 1
        self.most[q[last]] = np.minimum(self.most[q[last]], d[order[last]])
        self.q, self.d, self.item, self.label = q[rank < self.k], d[keep], item[keep], label[keep]
        return self


def _nearest(queries, k: int, key: str):
    """Per partition the k nearest rows of each query, with exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        if not len(ids):
            return
        best = _Best(ids, vectors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                best.add(np.asarray(part.column(0)), _matrix(part.column(1)), np.asarray(part.column(2)))
        best.done()
        columns = [pa.array(ids[best.q]), pa.array(best.item), pa.array(best.label.astype(np.int32)), pa.array(best.d)]
        yield pa.RecordBatch.from_arrays(columns, [key, "item_id", "label", "dist"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, item_id, label, dist, rn): the k nearest rows (vec_id, embedding, label) of each query, itself excluded.

    Null embeddings are left out; ties go by item_id.
    """
    spark = rows.sparkSession
    rows = rows.where("embedding is not null").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    parts, block = [], []

    def send(block: list) -> None:
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in block], np.int64), np.array([r.embedding for r in block], np.float64)))
        parts.append(rows.mapInArrow(_nearest(sent, k, "query_id"), "query_id long, item_id long, label int, dist double"))

    for r in queries.where("embedding is not null").select("vec_id", "embedding").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_QUERIES:
            send(block)
            block = []
    if block or not parts:
        send(block)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "item_id"))
    return found.withColumn("rn", rank).where(F.col("rn") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """(query_id, label, score, first_rn, rank): weights 1 / (d + eps)^2, normalised per query, summed per label."""
    weight = F.lit(1.0) / F.pow(F.col("dist") + F.lit(EPSILON), 2)
    weighted = neighbours.withColumn("w", weight)
    # k rows per query at most: the window's partitions are tiny whatever the data is.
    shares = weighted.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))
    summed = shares.groupBy("query_id", "label").agg(F.sum("share").alias("score"), F.min("rn").alias("first_rn"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first_rn")))


def clusters(labelled: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Labelled embeddings whose label is in the vocabulary, with dense item ids."""
    from slotloom.operators.labels import dense_ids

    return dense_ids(labelled.join(vocabulary, "label", "left_semi"), "vec_id", "item_id")


def cells_for(n: int) -> int:
    """About the square root of the rows, at most what the sample can place."""
    return max(LEAST_CELLS, min(math.isqrt(max(n, 1)), SAMPLE_ROWS // ROWS_PER_CELL))


class InvertedFile:
    """Centroids and the rows (vec_id, embedding, label) by their cells."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame):
        self.centroids, self.rows = centroids, rows

    @classmethod
    def build(cls, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE_ROWS, seed: int = 0) -> InvertedFile:
        """Fits centroids on the ``sample`` rows with the smallest hash of vec_id; indexes every row."""
        rows = rows.where("embedding is not null").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
        picked = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").collect()
        x = np.array([r.embedding for r in picked], np.float64)
        if not len(x):
            return cls(np.zeros((0, 0)), rows.withColumn("cell", F.lit(0)))
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells or cells_for(rows.count()), len(x)), replace=False)]
        for _ in range(12):
            of = _closest(x, c)
            n = np.bincount(of, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, of, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return cls(c, rows.withColumn("cell", cls._cells(rows, c, 1)[0]))

    @staticmethod
    def _cells(rows: DataFrame, centroids: np.ndarray, n: int, column: str = "embedding"):
        sent = rows.sparkSession.sparkContext.broadcast(centroids)

        @F.pandas_udf("array<int>")
        def nearest_cells(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), np.float64)
            d = (sent.value**2).sum(1)[None, :] - 2 * x @ sent.value.T
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return nearest_cells(column)

    def save(self, path: str) -> None:
        """Centroids and indexed rows as two Parquet tables; the rows of a cell lie together."""
        spark = self.rows.sparkSession
        listed = [(i, row.tolist()) for i, row in enumerate(self.centroids)]
        spark.createDataFrame(listed, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        self.rows.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark, path: str) -> InvertedFile:
        found = sorted((r.cell, r.centroid) for r in spark.read.parquet(f"{path}/centroids").collect())
        return cls(np.array([c for _, c in found], np.float64).reshape(len(found), -1), spark.read.parquet(f"{path}/rows"))

    def probes_for(self, queries: DataFrame, k: int = K, recall: float = 0.95, sample: int = 200) -> int:
        """The least number of cells that hold ``recall`` of the true neighbours of the ``sample`` queries with the smallest hash."""
        asked = queries.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample).select("vec_id", "embedding")
        asked = asked.sparkSession.createDataFrame(asked.collect(), asked.schema)
        true = nearest(asked, self.rows, k).select("query_id", F.col("item_id"))
        of = true.join(self.rows.select(F.col("vec_id").alias("item_id"), "cell"), "item_id").groupBy("query_id", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
        vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in asked.collect()}
        at = np.zeros(len(self.centroids))
        for r in of:
            d = ((self.centroids - vectors[r.query_id]) ** 2).sum(1)
            at[int((d < d[r.cell]).sum())] += r.n
        if not at.sum():
            return len(self.centroids)
        return int(np.searchsorted(np.cumsum(at), recall * at.sum() - 1e-9)) + 1

    def search(self, queries: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
        """(query_id, item_id, label, dist, rn) among the rows of each query's ``probes`` nearest cells (by ``probes_for`` if not given)."""
        schema = "query_id long, item_id long, label int, dist double"
        spark = queries.sparkSession
        queries = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        if not len(self.centroids):
            return spark.createDataFrame([], f"{schema}, rn int")
        probes = probes or self.probes_for(queries.withColumnsRenamed({"query_id": "vec_id", "query": "embedding"}), k)
        asked = queries.select("query_id", "query", F.explode(self._cells(queries, self.centroids, min(probes, len(self.centroids)), "query")).alias("cell"))
        size = max(1, BLOCK_VALUES // max(1, self.centroids.shape[1]))
        chunked = lambda df: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        # One row per cell on either side, so hot cells and hot queries are cut into blocks of a bounded size.
        cells = F.broadcast(chunked(self.rows).withColumnRenamed("n", "of_rows").join(chunked(asked).withColumnRenamed("n", "of_queries"), "cell"))
        part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows.join(cells, "cell").select("cell", part("vec_id", "of_rows").alias("r"), every("of_queries").alias("q"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
        asked = asked.join(cells, "cell").select("cell", every("of_rows").alias("r"), part("query_id", "of_queries").alias("q"), "query_id", "query")

        def meet(theirs: pd.DataFrame, ours: pd.DataFrame) -> pd.DataFrame:
            if not len(theirs) or not len(ours):
                return pd.DataFrame({"query_id": [], "item_id": [], "label": [], "dist": []}).astype({"query_id": "int64", "item_id": "int64", "label": "int32"})
            parts, vectors, labels = [], np.array(ours["vector"].tolist(), np.float64), ours["label"].fillna(-1).to_numpy().astype(np.int64)
            for at in range(0, len(theirs), 512):
                some = theirs.iloc[at : at + 512]
                best = _Best(some["query_id"].to_numpy(), np.array(some["query"].tolist(), np.float64), k)
                for lo in range(0, len(vectors), 4096):
                    best.add(ours["item_id"].to_numpy()[lo : lo + 4096], vectors[lo : lo + 4096], labels[lo : lo + 4096])
                best.done()
                parts.append(pd.DataFrame({"query_id": best.ids[best.q], "item_id": best.item, "label": best.label.astype(np.int32), "dist": best.d}))
            return pd.concat(parts)

        found = asked.groupBy("cell", "r", "q").cogroup(rows.groupBy("cell", "r", "q")).applyInPandas(meet, schema)
        return found.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "item_id"))).where(F.col("rn") <= k)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of c for each row of x, in slices."""
    norms = (c * c).sum(1)[None, :]
    return np.concatenate([(norms - 2 * x[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(x), 4096)])
