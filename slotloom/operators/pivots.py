"""Exact nearest neighbours of a whole table of queries, as a Spark join pruned by the triangle inequality.

1. Pivots are the centroids of an inverted file (fitted on a bounded sample).  Every row goes to the cell
   of its nearest pivot; a cell has a number of rows and a radius.  Both have one row per pivot.
2. Equal vectors are one class: their rows' ``k`` + 1 smallest ids stand for all of them, as no others can be among
   anyone's nearest, and a class asks once.  So a vector that a third of all rows share costs as much as any other.
3. First round: a class meets the rows of its nearest cells that hold ``k`` + 1 of them.  The distance of the last is its bound.
4. Second round: it meets those cells only that may hold something nearer, by the cell's ball
   (distance to the pivot less the radius) and by the plane between the two pivots.

Cells near to one another lie in one block of rows; a query travels once to each block that has a cell for it, not once per cell, and a block
once to each group of the queries that it gets. Blocks and groups have a bounded size, and inside of a pair of them cells are
left out as bounds become smaller. So a task's memory is bounded, and what is shuffled grows by a copy of the table for every
``knn.BLOCK_VALUES`` values of it, where bounds leave all cells. Nothing but the pivots and a row per cell or block is
broadcast or seen by the driver.

Defined results: null embeddings neither ask nor are found; ties go by item_id; a row is never its own
neighbour; with fewer than k others a query gets those; an empty table on either side gives no rows; embeddings with NaN aren't supported.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotloom.operators import knn
from slotloom.sources.tables import even_keys, written

ROUNDING = 1e-9
FOUND = "query_id long, item_id long, dist double"
#: Rows that a block holds at least, if there are as many; queries and rows that are compared at once.
LEAST_ROWS, AT_ONCE = 1000, 1024


def classes(rows: DataFrame, kept: int) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, embedding) as (vec_id, class) and the ``kept`` rows with the smallest ids of each class as (vec_id, embedding, class).

    A class is named by its smallest id.  Ids are cut per salted part of a class first, so a class may hold nearly all rows.
    """
    rows = rows.where("embedding is not null")
    firsts = rows.groupBy("embedding").agg(F.min("vec_id").alias("class"))
    named = rows.join(firsts, "embedding").select("vec_id", "embedding", "class")
    salted = named.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    for by in (("class", "salt"), ("class",)):
        salted = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("nth") <= kept)
    return named.select("vec_id", "class"), salted.select("vec_id", "embedding", "class")


def _side_by_side(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of the points, near ones near to one another: halves along the widest axis, again and again."""
    if len(at) < 3:
        return at
    order = at[points[at, points[at].var(0).argmax()].argsort(kind="stable")]
    half = len(order) // 2
    return np.concatenate([_side_by_side(points, order[:half]), _side_by_side(points, order[half:])])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


class PivotJoin:
    """Cells of labelled rows (vec_id, embedding, label), ready to answer any table of queries exactly."""

    def __init__(self, rows: DataFrame, k: int = knn.K, cells: int | None = None):
        self.spark, self.k = rows.sparkSession, k
        rows = rows.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
        self.labels = rows.select(F.col("vec_id").alias("item_id"), "label")
        _, some = classes(rows.select("vec_id", "embedding"), k + 1)
        index = knn.InvertedFile.build(written(some, "pivot-classes").withColumn("label", F.lit(0)), cells)
        self.pivots = index.centroids
        rows = written(index.rows.select("vec_id", "embedding", "cell"), "pivot-rows")
        found = rows.select("cell", self._distance("embedding", "cell").alias("d")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()
        self.sizes, self.radii = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        for r in found:  # a row per pivot
            self.sizes[r.cell], self.radii[r.cell] = r.n, r.radius
        self._place(rows)

    def _place(self, rows: DataFrame) -> None:
        """Cells as pieces of at most ``most`` rows, about, and blocks of such pieces; every row's piece and block."""
        # Small tables are cut too, so that every core has pairs of blocks.
        even = math.ceil(int(self.sizes.sum()) / math.ceil(math.sqrt(4 * self.spark.sparkContext.defaultParallelism)))
        self.most = max(1, min(knn.BLOCK_VALUES // max(1, self.pivots.shape[1]), max(LEAST_ROWS, even)))
        self.pieces: list[list[int]] = [[] for _ in self.pivots]
        self.blocks: list[list[int]] = [[] for _ in self.pivots]
        piece = block = held = 0
        for cell in _side_by_side(self.pivots, np.arange(len(self.pivots))):
            parts = max(1, math.ceil(self.sizes[cell] / self.most))
            for _ in range(parts):
                n = self.sizes[cell] / parts
                block, held = (block + 1, n) if held and held + n > self.most else (block, held + n)
                self.pieces[cell].append(piece)
                self.blocks[cell].append(block)
                piece += 1
        places = self.spark.createDataFrame(list(zip(range(len(self.pivots)), self.pieces, self.blocks)), "cell int, pieces array<int>, blocks array<int>")
        at = F.pmod(F.xxhash64("vec_id"), F.size("pieces")).cast("int")
        self.rows = rows.join(F.broadcast(places), "cell").select("vec_id", "embedding", "cell", F.get("pieces", at).alias("piece"), F.get("blocks", at).alias("block"))

    def _distance(self, vector: str, cell: str):
        sent = self.spark.sparkContext.broadcast(self.pivots)

        @F.pandas_udf("double")
        def distance(v: pd.Series, c: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=float)
            return pd.Series(_norms(np.array(v.tolist()) - sent.value[c.to_numpy()]))

        return distance(vector, cell)

    def _first_pieces(self, vector: str):
        """The nearest cell, the pieces of the nearest cells that together hold k + 1 rows, and how many rows these have."""
        sent, k = self.spark.sparkContext.broadcast((self.pivots, self.sizes, self.pieces)), self.k

        @F.pandas_udf("near int, piece array<int>, met long")
        def cells(v: pd.Series) -> pd.DataFrame:
            pivots, sizes, pieces = sent.value
            out = []
            for x in v:
                order = np.argsort(((pivots - np.asarray(x)) ** 2).sum(1), kind="stable")
                near, order = order[0], order[sizes[order] > 0]
                order = order[: int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1]
                out.append((int(near), [p for c in order for p in pieces[c]], int(sizes[order].sum())))
            return pd.DataFrame(out, columns=["near", "piece", "met"])

        return cells(vector)

    def _blocks_within(self, vector: str, near: str, bound: str):
        """The blocks of the cells that may hold a row within the bound, and how many rows the cells have."""
        sent = self.spark.sparkContext.broadcast((self.pivots, self.sizes, self.radii, self.blocks))

        @F.pandas_udf("block array<int>, met long")
        def cells(v: pd.Series, n: pd.Series, b: pd.Series) -> pd.DataFrame:
            pivots, sizes, radii, blocks = sent.value
            out = []
            for x, home, most in zip(v, n, b):
                d = _norms(pivots - np.asarray(x))
                most = np.inf if most is None or np.isnan(most) else most
                wanted = np.flatnonzero((sizes > 0) & (_least(d, d[home], _norms(pivots - pivots[home]), radii) <= most + ROUNDING * (1 + d)))
                out.append((sorted({i for c in wanted for i in blocks[c]}), int(sizes[wanted].sum())))
            return pd.DataFrame(out, columns=["block", "met"])

        return cells(vector, near, bound)

    def _meet(self, asked: DataFrame, by: str) -> DataFrame:
        """Nearest rows within the bounds, in the pieces or blocks listed, of (query_id, query, near, bound, piece or block): k + 1 at most of each."""
        k, pivots, radii = self.k + 1, self.pivots, self.radii
        sent = self.spark.sparkContext.broadcast((pivots, radii))
        many = {r.part: math.ceil(r["count"] / self.most) for r in asked.select(F.explode(by).alias("part")).groupBy("part").count().collect()}  # a row per piece or block
        tasks = max(1, sum(many.values()))
        keys = iter(even_keys(self.spark, tasks))
        dealt = F.broadcast(self.spark.createDataFrame([(part, [next(keys) for _ in range(n)]) for part, n in many.items()], "part int, groups array<int>"))
        rows = self.rows.withColumnRenamed(by, "part").join(dealt, "part").select(F.explode("groups").alias("group"), F.col("vec_id").alias("item_id"), "cell", F.col("embedding").alias("vector"))
        asked = asked.withColumn("part", F.explode(by)).join(dealt, "part").select(F.get("groups", F.pmod(F.xxhash64("query_id"), F.size("groups")).cast("int")).alias("group"), "query_id", "query", "near", "bound")

        def meet(theirs: pa.Table, ours: pa.Table) -> pa.Table:
            pivots, radii = sent.value
            parts = [pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})]
            if not theirs.num_rows or not ours.num_rows:
                return parts[0]
            order = np.argsort(cells := ours["cell"].to_numpy(), kind="stable")
            cells, items, vectors = cells[order], ours["item_id"].to_numpy()[order], knn._matrix(ours["vector"])[order]
            edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
            for at in range(0, theirs.num_rows, AT_ONCE):
                some = theirs.slice(at, AT_ONCE)
                ids, x, bounds, home = some["query_id"].to_numpy(), knn._matrix(some["query"]), some["bound"].to_numpy(), pivots[some["near"].to_numpy()]
                # A class may be near to itself: its other rows are.
                best = knn._Best(np.full(len(x), np.iinfo(np.int64).min), x, k, np.where(np.isnan(bounds), np.inf, bounds))
                to_home = _norms(x - home)
                for lo, hi in zip(edges[:-1], edges[1:]):
                    pivot = pivots[cells[lo]]
                    d = _norms(x - pivot)
                    wanted = np.flatnonzero(_least(d, to_home, _norms(home - pivot), radii[cells[lo]]) <= best.most + ROUNDING * (1 + d))
                    for i in range(lo, hi, AT_ONCE):
                        j = min(i + AT_ONCE, hi)
                        best.add(items[i:j], vectors[i:j], np.zeros(j - i, np.int64), wanted)
                best.done()
                parts.append(pa.table({"query_id": ids[best.q], "item_id": best.item, "dist": best.d}))
            return pa.concat_tables(parts)

        return asked.repartition(tasks, "group").groupBy("group").cogroup(rows.repartition(tasks, "group").groupBy("group")).applyInArrow(meet, FOUND)

    def _best(self, found: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "item_id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= self.k + 1)

    def join(self, queries: DataFrame) -> DataFrame:
        """(query_id, item_id, label, dist, rn): the k nearest rows of every query (vec_id, embedding).

        ``share``, afterwards, is the share of all pairs of classes and rows that were compared, at most.
        """
        queries = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        members, asking = classes(queries, 1)
        if not len(self.pivots):
            return self.spark.createDataFrame([], "query_id long, item_id long, label int, dist double, rn int")
        members = written(members, "pivot-members")
        asking = asking.select(F.col("class").alias("query_id"), F.col("embedding").alias("query"))
        asking = written(asking.withColumn("to", self._first_pieces("query")).select("query_id", "query", "to.near", "to.piece", "to.met"), "pivot-queries")
        first = self._best(self._meet(asking.withColumn("bound", F.lit(None).cast("double")), "piece"))
        bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) > self.k, F.max("dist")).alias("bound"))
        more = asking.select("query_id", "query", "near").join(bounds, "query_id", "left").withColumn("to", self._blocks_within("query", "near", "bound"))
        more = written(more.select("query_id", "query", "near", "bound", "to.block", "to.met"), "pivot-more")
        found = written(self._best(self._meet(more, "block")), "pivot-found")
        met = asking.select("met").unionByName(more.select("met")).agg(F.sum("met")).first()[0] or 0
        self.share = met / max(1, asking.count() * int(self.sizes.sum()))
        # Members of a class have its neighbours, each without itself.
        own = members.select(F.col("vec_id").alias("own"), F.col("class").alias("query_id")).join(found, "query_id").where("own <> item_id")
        rank = F.row_number().over(Window.partitionBy("own").orderBy("dist", "item_id"))
        ranked = own.withColumn("rn", rank).where(F.col("rn") <= self.k)
        return ranked.join(self.labels, "item_id").select(F.col("own").alias("query_id"), "item_id", "label", "dist", "rn")


def _least(d: np.ndarray, to_home: np.ndarray, gap: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What the rows of cells are away at least, from the distances to their pivots, to the home cell's, and from this to theirs.

    A row of a cell lies in its ball, and on its pivot's side of the plane between the two.
    """
    plane = np.where(gap > 0, (d**2 - to_home**2) / np.maximum(2 * gap, 1e-300), 0)
    return np.maximum(d - radii, plane)
