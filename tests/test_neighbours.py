"""Exact search, the inverted file and the triplet queries on vectors with structure."""

import numpy as np
import pytest

from slotloom.operators import knn, triplets

SCHEMA = "vec_id long, embedding array<double>, label int"


def clustered(spark, n=6000, clusters=60, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 4
    rows = [(i, (centres[i % clusters] + rng.normal(size=dims)).tolist(), i % clusters) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def pairs(found):
    return {(r.query_id, r.item_id) for r in found.select("query_id", "item_id").collect()}


def test_index_on_clustered_vectors(spark, tmp_path):
    rows = clustered(spark).cache()
    queries = rows.where("vec_id % 100 = 0")
    index = knn.InvertedFile.build(rows)
    assert len(index.centroids) == knn.cells_for(6000) == 77
    index.save(f"file://{tmp_path}/index")
    index = knn.InvertedFile.load(spark, f"file://{tmp_path}/index")
    probes = index.probes_for(queries)
    sizes = {r.cell: r.n for r in index.rows.groupBy("cell").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    # The cells that a query probes, by their rows.
    read = []
    for r in queries.collect():
        near = ((index.centroids - np.array(r.embedding)) ** 2).sum(1).argsort()[:probes]
        read.append(sum(sizes.get(int(c), 0) for c in near) / 6000)
    assert np.mean(read) < 0.2
    exact = pairs(knn.nearest(queries, rows))
    assert len(exact & pairs(index.search(queries))) >= 0.9 * len(exact)


@pytest.mark.parametrize("values", [16 * 50, 4_000_000])
def test_index_with_all_cells_is_exact(spark, values, monkeypatch):
    """Blocks of 50 rows and queries, also of one hot cell, give what the exact search gives."""
    monkeypatch.setattr(knn, "BLOCK_VALUES", values)
    rows = clustered(spark, 600, 5)
    queries = rows.where("vec_id % 3 = 0")
    index = knn.InvertedFile.build(rows, cells=4)
    found = index.search(queries, probes=4)
    key = lambda df: {(r.query_id, r.rn): (r.item_id, r.label, round(r.dist, 9)) for r in df.collect()}
    assert key(found) == key(knn.nearest(queries, rows))


def test_ties_of_equal_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(3000)], SCHEMA).coalesce(1)
    asked = spark.createDataFrame([(10**6, [0.0, 0.0], 0)], SCHEMA)
    assert [r.item_id for r in knn.nearest(asked, rows).orderBy("rn").collect()] == list(range(10))
    assert [r.item_id for r in knn.InvertedFile.build(rows).search(asked, probes=1).orderBy("rn").collect()] == list(range(10))


def test_index_edges(spark):
    rows = clustered(spark, 60, 3)
    index = knn.InvertedFile.build(rows.limit(0))
    assert index.search(rows).count() == 0
    index = knn.InvertedFile.build(rows)
    assert index.search(rows.limit(0), probes=2).count() == 0
    nothing = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert knn.InvertedFile.build(rows.unionByName(nothing)).rows.count() == 60 and index.search(nothing, probes=1).count() == 0


def test_neighbours_as_triplets(spark):
    rows = spark.createDataFrame([(1, "b"), (5, "a"), (3, "b"), (9, "a"), (4, "c"), (7, "b"), (8, None)], "vec_id long, label string")
    got = {tuple(r) for r in triplets.neighbours_as_triplets(rows).collect()}
    assert got == {(5, 9, 1), (1, 3, 4), (3, 7, 4)}
