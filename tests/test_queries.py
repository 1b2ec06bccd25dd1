"""Every query of the catalog: against its SQL where there is one, else against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from slotloom.plans import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, catalog.QUERIES[name], catalog.SQL[name])


#: Queries without SQL; each has a test of its result below.
NOT_IN_SQL = {"knn_ann", "forest_ann", "cbow_vectors", "w2v", "pca", "lsh", "encoder_forward"}


@pytest.mark.parametrize("name", ["live_votes", "admission_stream", "stream_window_count"])
def test_streams_of_tables_that_are_folders(spark, sf_dir, tmp_path, name):
    """A table is a folder of files as soon as it is large; the result is that of one file."""
    for table in ("embeddings", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{table}.parquet")
    got, want = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (f"file://{tmp_path}", sf_dir))
    assert got == want and got


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == NOT_IN_SQL


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return {r.vec_id: (np.array(r.embedding, np.float64), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}


def distances(vectors, query):
    ids = np.array([i for i in vectors if i != query])
    return ids, np.linalg.norm(np.stack([vectors[i][0] for i in ids]) - vectors[query][0], axis=1)


@pytest.mark.parametrize("name", ["knn_ann", "forest_ann"])
def test_ann(spark, sf_dir, vectors, name):
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    assert {r.query_id for r in rows} == {i for i in vectors if i % 100 == 0}
    hits = total = 0
    for query in {r.query_id for r in rows}:
        ids, d = distances(vectors, query)
        true = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = [r for r in rows if r.query_id == query]
        assert all(np.isclose(r.dist, d[ids == r.item_id][0], atol=1e-5) and r.label == vectors[r.item_id][1] for r in mine)
        hits, total = hits + len(true & {r.item_id for r in mine}), total + len(true)
    assert hits >= 0.9 * total


def test_lsh(spark, sf_dir, vectors):
    rows = catalog.QUERIES["lsh"](spark, sf_dir).collect()
    found = {(r.query_id, r.item_id): r.dist for r in rows}
    true = {}
    for query in (i for i in vectors if i % 100 == 0):
        ids, d = distances(vectors, query)
        true |= {(query, int(i)): x for i, x in zip(ids, d) if x < 1.2}
    # What is found is right; hashing may miss some.
    assert all(np.isclose(x, true[k]) for k, x in found.items())
    assert len(found) >= 0.6 * len(true)


def test_pca(spark, sf_dir, vectors):
    rows = {r.vec_id: np.array(r.embedding) for r in catalog.QUERIES["pca"](spark, sf_dir).collect()}
    ids = sorted(rows)
    x = np.stack([vectors[i][0] for i in ids])
    _, _, components = np.linalg.svd(x - x.mean(0), full_matrices=False)
    mine, plain = np.stack([rows[i] for i in ids]), x @ components[:16].T
    # The same components but for their signs.
    assert mine.shape == plain.shape and np.allclose(np.abs(mine), np.abs(plain), atol=1e-6)


@pytest.mark.parametrize("name", ["w2v", "cbow_vectors"])
def test_word_vectors(spark, sf_dir, name):
    rows = {r.word: np.array(r.vector if name == "cbow_vectors" else r.vector.toArray()) for r in catalog.QUERIES[name](spark, sf_dir).collect()}
    counts = Counter(w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for w in (r.text or "").split())
    assert set(rows) == {w for w, n in counts.items() if n >= 5}
    assert all(v.shape == (100,) and np.isfinite(v).all() for v in rows.values()) and any(v.any() for v in rows.values())


def test_encoder_forward(spark, sf_dir, vectors):
    """One row after the other, one place after the other."""
    from slotloom.operators.encoder import Encoder

    model = Encoder.random(8, 16, 10, 12)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def last(x, w, way):
        h, c = [0.0] * 16, [0.0] * 16
        for row in x:
            gates = [float(w[f"{way}_b"][g] + np.dot(w[f"{way}_x"][g], row) + np.dot(w[f"{way}_h"][g], h)) for g in range(64)]
            c = [sigmoid(gates[16 + j]) * c[j] + sigmoid(gates[j]) * math.tanh(gates[32 + j]) for j in range(16)]
            h = [sigmoid(gates[48 + j]) * math.tanh(c[j]) for j in range(16)]
        return h

    got = {r.id: np.array(r.embedding) for r in catalog.QUERIES["encoder_forward"](spark, sf_dir).collect()}
    assert set(got) == set(vectors)
    for i in sorted(vectors)[:5]:
        v, label = vectors[i]
        joined = []
        for at, w in ((0, model.identifiers), (32, model.tokens)):
            x = [v[at + 8 * k : at + 8 * k + 8].astype(np.float32) for k in range(4)]
            joined += last(x, w, "fw") + last(x[-1:], w, "bw")
        joined += [float(k == label) for k in range(10)]
        assert np.allclose(got[i], model.weight @ np.array(joined) + model.bias, atol=1e-4)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
