"""Unit tests of the engine's functions and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.functions import text, types
from slotloom.operators import datapoints, encoder, evaluate, extract, features, knn, labels, reduce, triplets, typecheck
from slotloom.sources import corpus


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("typing.List[int]", "List[int]"), ("pytest.Foo", "pytesFoo"), ("concurrent.futures.Future", "concurrenfutures.Future"), ("'Foo'", "Foo"), ("company", "compAny"), ("[]", "list"), ("Tuple[int, ...]", "Tuple[int]"),
        ("Literal['a']", "Literal"), ("Iterator[Any]", "Iterator[Any]"), ("IteratorA", "Iterator"), ("List[Text]", "List[str]"), ("Callable[..., Any]", "Callable"),
    ],
)
def test_normalised(spark, raw, want):
    assert one(spark, raw, types.normalised) == want


def test_anchored_prefixes(spark):
    assert one(spark, "pytest.Foo[t.Any]", lambda c: types.strip_prefixes(c, anchored=True)) == "pytest.Foo[Any]"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("int", "int"), ("Dict[str, Dict[str, Any]]", "Dict[str, Dict[str, Any]]"), ("List[Callable[..., Any]]", "List[Callable[..., Any]]"), ("List[List[List[int]]]", "List[List[Any]]"),
        ("Union[int, List[Tuple[int, str]]]", "Union[int, List[Any]]"), ("List[int]]", None), ("Callable[[int], str]", "Callable[[int], str]"),
    ],
)
def test_depth(spark, raw, want):
    assert one(spark, raw, types.reduce_depth) == want


def test_outer_name_is_greedy(spark):
    assert one(spark, "Dict[str, List[int]]", types.outer_name) == "Dict[str, List"


def test_identifier_split(spark):
    assert one(spark, "maxHTTPSize_v2", text.split_identifier) == "max http size v 2"


def test_scores_sum_to_one_and_ties_keep_nearest_first(spark):
    rows = spark.createDataFrame([(1, 10, 5, 1.0, 1), (1, 11, 6, 1.0, 2), (1, 12, 6, 3.0, 3)], "query_id long, item_id long, label int, dist double, rn int")
    got = {r.label: r for r in knn.vote(rows).collect()}
    assert math.isclose(sum(r.score for r in got.values()), 1.0)
    tie = spark.createDataFrame([(1, 10, 9, 1.0, 1), (1, 11, 2, 1.0, 2)], "query_id long, item_id long, label int, dist double, rn int")
    assert [r.label for r in knn.vote(tie).orderBy("rank").collect()] == [9, 2]


def test_nearest_handles_nulls_and_blocks(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").unionByName(spark.createDataFrame([(10**9, None, 1)], "vec_id long, embedding array<float>, label int"))
    queries = rows.where("vec_id % 100 = 0")
    whole = {(r.query_id, r.rn): r.item_id for r in knn.nearest(queries, rows).collect()}
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 2)
    assert {(r.query_id, r.rn): r.item_id for r in knn.nearest(queries, rows).collect()} == whole
    assert knn.nearest(queries.limit(0), rows).count() == 0


def test_nearest_ties_go_by_id(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(600, 8))
    vectors[rng.permutation(600)[:200]] = 0.25
    vectors[0] = 0.3
    rows = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").coalesce(1)
    got = [r.item_id for r in knn.nearest(rows.where("vec_id = 0"), rows).orderBy("rn").collect()]
    equal = [i for i in range(1, 600) if (vectors[i] == 0.25).all()]
    assert got == equal[:10]


def test_index_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.where("vec_id % 100 = 0")
    exact = {(r.query_id, r.item_id) for r in knn.nearest(queries, rows).collect()}
    found = {(r.query_id, r.item_id) for r in knn.InvertedFile.build(rows).search(queries, probes=48).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_dense_ids(spark):
    rows = spark.createDataFrame([(chr(97 + i % 26) * (i // 26 + 1),) for i in range(100)], "k string")
    got = [(r.k, r.i) for r in labels.dense_ids(rows, "k", "i").collect()]
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)
    assert sorted(i for _, i in got) == list(range(100))


def test_given_split_is_kept(spark):
    given = spark.createDataFrame([("a", "train"), ("b", "test")], "file string, set string")
    assert {r.split for r in datapoints.with_split(given).collect()} == {"train", "test"}
    partly = spark.createDataFrame([("a", "train"), ("b", None)], "file string, set string")
    assert {r.split for r in datapoints.with_split(partly).collect()} <= {"train", "valid", "test"}
    assert datapoints.shared_files(datapoints.with_split(partly)).count() == 0


def test_random_hints_are_repeatable(spark):
    ranked = spark.createDataFrame([("int", 9, 0), ("Point", 5, 1), ("list", 4, 2)], "type string, n long, rank int")
    rows = spark.createDataFrame([("int",), ("oi",), ("zzz",)], "aval_types string")
    first = [r.hint for r in labels.random_hint_codes(rows, ranked).collect()]
    assert first == [r.hint for r in labels.random_hint_codes(rows, ranked).collect()]
    assert first[2] == 2


def test_empty_tiers_are_null(spark):
    preds = spark.createDataFrame([("Foo", "Parameter", [("Foo", 1.0)])], "original_type string, task string, predictions array<struct<type:string,score:double>>")
    row = evaluate.report(evaluate.judged(preds, spark.createDataFrame([], "type string"))).where("task = 'Combined'").first()
    assert row.exact_common is None and row.exact_rare == 100.0


def test_parametric_match(spark):
    preds = spark.createDataFrame([("List[int]", "Return", [("List[str]", 0.6), ("list", 0.4)])], "original_type string, task string, predictions array<struct<type:string,score:double>>")
    row = evaluate.judged(preds, spark.createDataFrame([], "type string")).first()
    assert (row.hit, row.attempt, row.prr, row.phit) == (0, 1, 1.0, 1)


def test_lstm_matches_step_by_step():
    rng = np.random.default_rng(0)
    w = encoder.init_lstm(3, 4, rng)
    x = rng.normal(size=(2, 5, 3)).astype(np.float32)
    got = encoder.last_states(x, w)
    sig = lambda v: 1 / (1 + math.exp(-v))
    for row in range(2):
        h, c = [0.0] * 4, [0.0] * 4
        for t in range(5):
            z = [sum(w["fw_x"][g][k] * x[row, t, k] for k in range(3)) + sum(w["fw_h"][g][k] * h[k] for k in range(4)) + w["fw_b"][g] for g in range(16)]
            c = [sig(z[4 + j]) * c[j] + sig(z[j]) * math.tanh(z[8 + j]) for j in range(4)]
            h = [sig(z[12 + j]) * math.tanh(c[j]) for j in range(4)]
        assert np.allclose(got[row, :4], h, rtol=1e-3, atol=1e-5)


@pytest.mark.parametrize("variant", ["complete", "woi", "woc", "wov"])
def test_encoder_shapes(variant):
    e = encoder.Encoder.random(8, 16, 10, 12, variant)
    rng = np.random.default_rng(1)
    assert e.forward(rng.normal(size=(3, 4, 8)), rng.normal(size=(3, 2, 8)), np.eye(10)[:3]).shape == (3, 12)


def test_vectorised_leaves_unknown_rows_zero(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<float>")
    rows = spark.createDataFrame([(1, "a b a a"), (2, None)], "id long, sequence string")
    got = {r.id: r.matrix for r in features.vectorised(rows, vectors, 3, 2).collect()}
    assert got == {1: [[1.0, 2.0], [0.0, 0.0], [1.0, 2.0]], 2: [[0.0, 0.0]] * 3}


def test_mined_triplets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = {r.vec_id: r.label for r in rows.select("vec_id", "label").collect()}
    found = triplets.mined(rows).collect()
    assert len(found) == len(label)
    assert all(label[t.anchor] == label[t.positive] != label[t.negative] and t.anchor != t.positive for t in found)


def test_mined_triplets_draw_from_all_rows(spark):
    label = {i: 0 if i < 1200 else 1 + i % 3 for i in range(2400)}
    found = triplets.mined(spark.createDataFrame(list(label.items()), "vec_id long, label int")).collect()
    assert len(found) == 2400 and all(label[t.anchor] == label[t.positive] != label[t.negative] and t.anchor != t.positive for t in found)
    assert len({t.positive for t in found if label[t.anchor] == 0}) > 600
    assert len({t.negative for t in found if label[t.anchor] == 0}) > 600
    assert len({(label[t.anchor], label[t.negative]) for t in found}) == 12


def test_word_vectors_take_the_defaults(spark, sf_dir, monkeypatch):
    from slotloom.plans import catalog

    asked = []
    train = features.train_word_vectors
    monkeypatch.setattr(features, "train_word_vectors", lambda *a, **k: asked.append(k) or train(*a, **k))
    assert len(catalog.QUERIES["w2v"](spark, sf_dir).first().vector) == features.VECTOR_SIZE and asked == [{}]


def test_word_vectors_are_trained_by_several_tasks(spark, monkeypatch):
    import pyspark.ml.feature as ml

    asked, fit = [], ml.Word2Vec.fit
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda self, df: asked.append(self.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(features, "TASK_WORDS", 100)
    sentences = spark.createDataFrame([(["a", "b", "c", "d"],)] * 60 + [([],)], "sentence array<string>")
    assert features.train_word_vectors(sentences, 4, epochs=2).getVectors().count() == 4
    features.train_word_vectors(sentences.limit(20), 4, epochs=1)
    assert asked == [2, 1]


def test_similar_pairs_are_those_of_the_model_without_a_row_per_bucket(spark, sf_dir, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(reduce, "BLOCK_ROWS", 40)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 130").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    for bucket in (1.0, 0.05):
        found = reduce.similar(rows.where("vec_id < 60"), rows, 1.3, bucket, 3, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan
        vectors = rows.select("vec_id", array_to_vector("embedding").alias("vector"))
        model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="hashes", bucketLength=bucket, numHashTables=3, seed=5).fit(vectors)
        plain = model.approxSimilarityJoin(vectors.where("vec_id < 60"), vectors, 1.3, distCol="dist").selectExpr("datasetA.vec_id as q", "datasetB.vec_id as i", "dist").where("q <> i").collect()
        got = {(r.query_id, r.item_id): r.dist for r in found.collect()}
        assert len(plain) == len(got) > 0 and all(np.isclose(got[r.q, r.i], r.dist) for r in plain)


def test_pca_distances(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    full = reduce.reduced(rows, reduce.fit_pca(rows, 64)).orderBy("vec_id").limit(2).collect()
    plain = rows.orderBy("vec_id").limit(2).collect()
    d = lambda r: np.linalg.norm(np.array(r[0].embedding) - np.array(r[1].embedding))
    assert math.isclose(d(full), d(plain), rel_tol=1e-6)


def test_extracted_slots(spark):
    source = "x: int = 1\nclass A:\n    k = 2\n    def f(self, a: str, b=0):\n        y = a\n        return y\n"
    rows = spark.createDataFrame([("m.py", source), ("bad.py", "def ("), ("none.py", None)], "file string, text string")
    got = extract.extracted(rows).collect()
    assert {(r.scope, r.kind, r.name, r.annotation) for r in got if r.file == "m.py"} == {("", "Variable", "x", "int"), ("A", "Variable", "k", ""), ("A.f", "Parameter", "a", "str"), ("A.f", "Parameter", "b", ""), ("A.f", "Return", "f", ""), ("A.f", "Variable", "y", "")}
    assert [r.error for r in got if r.file == "bad.py"] == ["SyntaxError"]
    assert {r.file: r.coverage for r in extract.coverage(extract.extracted(rows)).collect()} == {"m.py": 0.33}


def test_annotated():
    out = typecheck.annotated("v = 1\ndef f(a):\n    w = a\n    return w\n", {"f.a": "int", "f.return": "int", "v": "int", "f.w": "List[int]"})
    assert out == "v: int = 1\n\ndef f(a: int) -> int:\n    w: List[int] = a\n    return w"


def test_greedy_verdicts(spark):
    # A checker of our own: it objects to any annotation "bad".
    script = "import sys; t = open(sys.argv[1]).read(); n = t.count(': bad'); [print('x [misc]') for _ in range(n)]; print('Success: none' if not n else f'Found {n} errors in 1 file (checked 1 source file)'); sys.exit(bool(n))"
    rows = spark.createDataFrame([("m.py", "def f(a, b):\n    return a\n", "f.a", "int", ["bad", "int", "str"]), ("m.py", "def f(a, b):\n    return a\n", "f.b", "", ["bad"])], "file string, text string, slot string, truth string, predictions array<string>")
    got = [(r.slot, r.prediction, r.kind, r.is_tc) for r in typecheck.greedy_verdicts(rows, ("python", "-c", script)).collect()]
    assert got == [("f.a", "bad", "p_not_equal_gt", False), ("f.a", "int", "p_equal_gt", True), ("f.a", "str", "p_not_equal_gt", True), ("f.b", "bad", "p_wo_gt", False)]


def test_module_documents(spark, tmp_path):
    doc = '{"variables_p": {"v": [["int", 0.12345], ["str", 2.68e-11]]}, "classes": [{"q_name": "A", "variables_p": {}, "funcs": [{"q_name": "A.f", "params_p": {"a": [["int", 1.0]]}, "variables_p": {}, "ret_type_p": []}]}], "funcs": []}'
    (tmp_path / "m.json").write_text(doc)
    got = {(r.scope, r.kind, r.name, r.type, r.score) for r in corpus.flattened_predictions(corpus.module_document(spark, f"file://{tmp_path}/m.json")).collect()}
    assert got == {("", "var", "v", "int", 0.123), ("", "var", "v", "str", 0.0), ("A.f", "param", "a", "int", 1.0)}


def test_datapoint_table_prunes(spark, tmp_path):
    rows = spark.createDataFrame([("Parameter", "train", 1, 2, 3, 4), ("Return", "test", 5, 6, 7, 8)], "task string, split string, identifiers int, tokens int, hint int, label int")
    corpus.write_datapoints(rows, str(tmp_path / "t"))
    plan = datapoints.load_split(spark.read.parquet(str(tmp_path / "t")), "test", "woc")
    assert [tuple(r) for r in plan.collect()] == [("Return", 5, 7, 8)]
    text_plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text_plan and "tokens" not in text_plan
