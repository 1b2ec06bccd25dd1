"""Exact neighbours of whole tables, the forest of trees, and their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.operators import forest, knn, pivots
from slotloom.sources import tables
from tests.test_neighbours import SCHEMA, clustered, pairs


def brute(rows, queries, k):
    """(query, rank) -> (item, label, distance), one query after the other."""
    known = [(i, np.array(v, float), x) for i, v, x in rows if v is not None]
    out = {}
    for q, v, _ in queries:
        if v is not None:
            near = sorted((float(np.sqrt(((np.array(v, float) - w) ** 2).sum())), i, x) for i, w, x in known if i != q)[:k]
            out |= {(q, n + 1): (i, x, round(d, 9)) for n, (d, i, x) in enumerate(near)}
    return out


def found(df):
    return {(r.query_id, r.rn): (r.item_id, r.label, round(r.dist, 9)) for r in df.collect()}


def test_all_rows_as_queries(spark):
    rows = clustered(spark, 1500, 30, 8).cache()
    plain = [tuple(r) for r in rows.collect()]
    join = pivots.PivotJoin(rows, k=5)
    assert found(join.join(rows)) == brute(plain, plain, 5)
    # Clusters far apart: few pairs are compared.
    assert join.share < 0.2


@pytest.mark.parametrize("block", [8 * 40, 4_000_000])
def test_many_equal_vectors(spark, block, monkeypatch):
    """A third of the rows is one vector; blocks of 40 rows give the same."""
    monkeypatch.setattr(knn, "BLOCK_VALUES", block)
    rng = np.random.default_rng(1)
    plain = [(i, ([1.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()), i % 4) for i in range(400)] + [(900, None, 1), (901, [0.0] * 8, 2), (902, [0.0] * 8, 3)]
    rows = spark.createDataFrame(plain, SCHEMA).repartition(4)
    asked = [(i, v, x) for i, v, x in plain if i % 2 == 0] + [(5000, [1.0] * 8, 0), (5001, None, 0)]
    join = pivots.PivotJoin(rows, k=4, cells=9)
    assert found(join.join(spark.createDataFrame(asked, SCHEMA))) == brute(plain, asked, 4)


def test_queries_travel_by_block_not_by_cell(spark, monkeypatch):
    """Where bounds leave all cells, no written table has a row for every query and cell."""
    rng = np.random.default_rng(2)
    plain = [(i, rng.normal(size=32).tolist(), i % 4) for i in range(1200)]
    asked, counts = plain[::12], {}
    kept = pivots.written

    def counted(df, name):
        out = kept(df, name)
        counts[name] = max(out.count(), counts.get(name, 0))
        return out

    monkeypatch.setattr(pivots, "written", counted)
    join = pivots.PivotJoin(spark.createDataFrame(plain, SCHEMA), k=5)
    assert found(join.join(spark.createDataFrame(asked, SCHEMA))) == brute(plain, asked, 5)
    assert join.share > 0.5 and max(counts.values()) <= len(plain)


def test_even_keys_give_each_task_one_group(spark):
    keys = tables.even_keys(spark, 37)
    to = spark.createDataFrame([(k,) for k in keys], "key int").repartition(37, "key").select(F.spark_partition_id().alias("p")).collect()
    assert len(set(keys)) == 37 and len({r.p for r in to}) == 37


def test_bounds_change_no_result(spark):
    """Known distances leave out rows beyond them only; ties at the distance stay."""
    rng = np.random.default_rng(3)
    rows, asked = rng.integers(0, 3, (400, 3)).astype(float), rng.integers(0, 3, (20, 3)).astype(float)
    ids, labels, of = np.arange(400), np.zeros(400, np.int64), np.full(20, -1)
    free, known = knn._Best(of, asked, 7), knn._Best(of, asked, 7, [sorted(np.linalg.norm(rows - q, axis=1))[6] for q in asked])
    for at in range(0, 400, 50):
        free.add(ids[at : at + 50], rows[at : at + 50], labels[at : at + 50])
        for some in (np.arange(0, 20, 2), np.arange(1, 20, 2)):
            known.add(ids[at : at + 50], rows[at : at + 50], labels[at : at + 50], some)
    a, b = ([(q, i, d) for q, i, d in zip(x.q.tolist(), x.item.tolist(), x.d.tolist())] for x in (free.done(), known.done()))
    assert a == b and len(a) == 140
    for q in range(20):
        d = np.linalg.norm(rows - asked[q], axis=1)
        assert [i for x, i, _ in a if x == q] == np.lexsort((ids, d))[:7].tolist()


def test_join_edges(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [0.0, 3.0], 1)], SCHEMA)
    none = rows.limit(0)
    assert found(pivots.PivotJoin(rows).join(rows)) == {(1, 1): (2, 1, 2.0), (2, 1): (1, 0, 2.0)}
    assert pivots.PivotJoin(none).join(rows).count() == 0 and pivots.PivotJoin(rows).join(none).count() == 0
    assert found(pivots.PivotJoin(rows.where("vec_id = 1")).join(rows)) == {(2, 1): (1, 0, 2.0)}


def test_forest_recall_append_and_reload(spark, tmp_path):
    rows = clustered(spark, 3000, 60, 16).cache()
    path = f"file://{tmp_path}/forest"
    first = forest.Forest.build(rows.where("vec_id % 4 <> 0"), path, trees=8, leaf=24)
    assert first.rows.count() == 2250 and first.postings.count() == 8 * 2250
    nodes = first.nodes.count()
    whole = first.append(rows.where("vec_id % 4 = 0"), 1)
    # The trees stay, and an append that runs again changes nothing.
    whole = whole.append(rows.where("vec_id % 4 = 0"), 1)
    assert whole.rows.count() == 3000 and whole.postings.count() == 8 * 3000 and whole.nodes.count() == nodes
    again = forest.Forest(spark, path)
    queries = rows.where("vec_id % 30 = 0")
    exact, got = pairs(knn.nearest(queries, rows)), again.search(queries)
    assert len(exact & pairs(got)) >= 0.9 * len(exact)
    real = {(r.query_id, r.item_id): r.dist for r in knn.nearest(queries, rows, 100).collect()}
    assert all(np.isclose(r.dist, real[r.query_id, r.item_id]) for r in got.where("rn <= 3").collect())
    # A leaf holds a small share of the rows.
    assert whole.postings.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] < 300
    with pytest.raises(ValueError):
        whole.append(rows, 0)


def test_forest_reach_follows_recall(spark, tmp_path, monkeypatch):
    """On vectors without clusters, with many rows for each leaf, enough leaves are opened; trees are fitted without a table per level."""
    names, kept = [], forest.written
    monkeypatch.setattr(forest, "written", lambda df, name: names.append(name) or kept(df, name))
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=24).tolist(), i % 4 or None) for i in range(3000)], SCHEMA).cache()
    index = forest.Forest.build(rows, f"file://{tmp_path}/r", trees=4, leaf=8, sample=300)
    queries = rows.where("vec_id % 30 = 0")
    exact, got = knn.nearest(queries, rows), index.search(queries)
    assert all(r.label == (r.item_id % 4 or None) for r in got.collect())
    key = lambda df: {(r.query_id, r.item_id): round(r.dist, 9) for r in df.collect()}
    exact, got = key(exact), key(got)
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact) and all(got[at] == exact[at] for at in exact.keys() & got.keys())
    assert index.reach_for(queries) > 10 * 10 * 4 and len(names) <= 4


def test_forest_candidates_are_rows_of_opened_leaves(spark, tmp_path, monkeypatch):
    """Blocks, steps and bits give the rows of the leaves that a best-first descent opens, and their exact order."""
    for name, n in (("QUERIES", 7), ("STEP", 3), ("ROWS", 40), ("LED", 2)):
        monkeypatch.setattr(forest, name, n)
    rng = np.random.default_rng(5)
    plain = [(i, [2.0] * 6 if i % 5 == 0 else rng.normal(size=6).tolist(), i % 3) for i in range(300)]
    rows = spark.createDataFrame(plain, SCHEMA)
    index = forest.Forest.build(rows, f"file://{tmp_path}/c", trees=3, leaf=8)
    trees = forest._Trees(index.nodes.collect(), 3)
    members = {}
    for r in index.postings.collect():
        members.setdefault((r.tree, r.leaf), set()).add(r.vec_id)
    assert all(sum(len(m) for (t, _), m in members.items() if t == tree) == 300 for tree in range(3))
    want = {}
    for i, v, _ in plain[:40]:
        # One leaf after the other, by the farthest plane on the way.
        far = {}
        for tree, node in members:
            way, at = 0.0, node
            while at > 1:
                n = trees.at[tree, at // 2]
                margin = float(trees.normals[n] @ np.array(v) - trees.offsets[n])
                way, at = max(way, -margin if at % 2 else margin), at // 2
            far[tree, node] = way
        candidates, held = set(), 0
        for at in sorted(members, key=lambda x: (round(far[x], 9), x)):
            if held >= 90:
                break
            candidates, held = candidates | members[at], held + len(members[at])
        want |= brute([r for r in plain if r[0] in candidates], [(i, v, 0)], 5)
    assert found(index.search(rows.where("vec_id < 40"), 5, reach=90)) == want


def test_forest_opens_everything_in_the_end(spark, tmp_path):
    """With a reach beyond all rows the answer is exact, also with a leaf of equal vectors."""
    plain = [(i, [1.0, 1.0] if i < 40 else [float(i % 7), float(i % 11)], i % 3) for i in range(120)] + [(500, None, 0)]
    rows = spark.createDataFrame(plain, SCHEMA)
    index = forest.Forest.build(rows, f"file://{tmp_path}/f", trees=3, leaf=8)
    assert found(index.search(rows, 5, reach=10**6)) == brute(plain, plain, 5)


def test_all_leaves_are_those_of_one_tree():
    """A search that opens everything meets each row once, not once per tree."""
    from types import SimpleNamespace

    trees = forest._Trees([SimpleNamespace(tree=t, node=1, normal=[1.0, 0.0], offset=0.5) for t in range(3)], 3)
    sizes = {(t, n): 5 for t in range(3) for n in (2, 3)}
    assert sorted(trees.opened(np.array([0.0, 0.0]), sizes, 30)) == [(0, 2), (0, 3)]
    assert sorted(trees.opened(np.array([0.0, 0.0]), sizes, 15)) == [(0, 2), (1, 2), (2, 2)]


def test_forest_edges(spark, tmp_path):
    rows = clustered(spark, 60, 3)
    empty = forest.Forest.build(rows.limit(0), f"file://{tmp_path}/e", trees=2)
    assert empty.search(rows).count() == 0
    filled = empty.append(rows, 1)
    assert filled.rows.count() == 60 and filled.search(rows.limit(0)).count() == 0 and filled.search(rows, 3).count() == 180
