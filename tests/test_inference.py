"""From sources to predictions in documents, through learning, reduction, bundle and type checks."""

import json

import numpy as np
import pytest

from slotloom.operators import extract, infer, knn, typecheck
from slotloom.plans import bundle, jobs
from slotloom.sources import corpus

SOURCE = "import os\nfrom shop.items import Basket, Item as Thing\n\nlimit: int = 3\n\n\ndef add(left, right):\n    total = left + right\n    return total\n\n\nclass Cart:\n    kind = 'x'\n\n    def size(self, item):\n        return item\n\n\ndef empty():\n    pass\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for i in range(20):
        folder = root / "ann" / f"repo{i:02d}"
        folder.mkdir(parents=True)
        (folder / "m.py").write_text(f"limit: int = {i}\nname: str = 'x'\n\n\ndef add{i}(left: int, right: typing.List[int]) -> int:\n    total: int = left + right[0]\n    return total\n\n\ndef greet{i}(who: str, often: int) -> str:\n    return who * often\n")
    (root / "again.txt").write_text("ann/repo03/m.py\n")
    out = str(tmp_path_factory.mktemp("out"))
    params = jobs.PARAMETERS | {"vector_size": 8, "w2v_epochs": 1, "min_count": 1, "top_n_hints": 4, "hidden_size": 6, "output_size": 5, "epochs": 2, "lr": 0.01, "batch_size": 32, "dimensions": 3}
    slots = jobs.extract_job(spark, f"file://{root}", out, limit=19, duplicates=f"file://{root}/again.txt")
    assert {r.file for r in slots.select("file").distinct().collect()} == {f"ann/repo{i:02d}/m.py" for i in range(20) if i != 3}
    jobs.preprocess_job(spark, out, params=params)
    jobs.vectorize_job(spark, out, params)
    model, history = jobs.learn_job(spark, out, params, workers=2)
    assert [h["epoch"] for h in history] == [1, 2] and spark.read.parquet(f"{out}/history").count() == 2
    jobs.predict_job(spark, out, model, params, vocabulary_limit=10)
    jobs.reduce_job(spark, out, 3, 10)
    return out, params, jobs.bundle_job(spark, out, f"{out}/bundle", params, reduced=True)


def test_word_model_has_the_six_columns(spark, built):
    out, _, _ = built
    words = {r.word for r in spark.read.parquet(f"{out}/words").collect()}
    assert {"left", "right", "total", "who", "greet", "add", "limit"} <= words
    from pyspark.ml.feature import Word2VecModel

    assert Word2VecModel.load(f"{out}/word_model").getVectors().count() == len(words)


def test_random_hints(spark, built):
    out, params, _ = built
    points = jobs.preprocess_job(spark, out, params=params, random_hints=True)
    # Nothing is imported, and every type contains the empty string: the first kept match, or the last code.
    assert 0 <= points.agg({"hint": "max"}).first()[0] <= 3
    jobs.preprocess_job(spark, out, params=params)


def test_bundle_round_trip(spark, built):
    _, params, loaded = built
    assert loaded.projection.shape == (5, 3) and loaded.vector_size == 8 and loaded.n_hints == 4 and loaded.k == 10
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0])], "vec_id long, embedding array<double>")
    from slotloom.operators.reduce import projected

    assert np.allclose(projected(rows, loaded.projection).first().embedding, np.array([1, 2, 3, 4, 5.0]) @ loaded.projection)


def test_predictions_of_sources(spark, built, tmp_path):
    out, _, loaded = built
    sources = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", ""), ("null.py", None)], "file string, text string")
    found = jobs.infer_job(spark, sources, f"{out}/bundle", str(tmp_path), filter_types=False).collect()
    slots = {(r.scope, r.level, r.kind, r.name) for r in found if r.file == "a.py"}
    assert slots == {("", "module", "Variable", "limit"), ("add", "function", "Parameter", "left"), ("add", "function", "Parameter", "right"), ("add", "function", "Return", "add"), ("add", "function", "Variable", "total"), ("Cart", "class", "Variable", "kind"), ("Cart.size", "function", "Parameter", "item"), ("Cart.size", "function", "Return", "size")}
    for r in found:
        if r.file == "a.py":
            assert {p.type for p in r.predictions} <= {"int", "str", "List[int]"} and r.predictions
            scores = [p.score for p in r.predictions]
            assert scores == sorted(scores, reverse=True) and np.isclose(sum(scores), 1)
    assert [(r.file, r.error) for r in found if r.error] == [("bad.py", "SyntaxError")]
    assert not [r for r in found if r.file in ("none.py", "null.py")]
    # The neighbours' vote, slot by slot.
    documents = {r.file: json.loads(r.module) for r in spark.read.json(f"{tmp_path}/documents").collect()}
    assert documents["bad.py"] == {"error": "SyntaxError"}
    whole = documents["a.py"]
    assert set(whole["variables_p"]) == {"limit"} and [f["q_name"] for f in whole["funcs"]] == ["add"] and [(c["q_name"], [f["q_name"] for f in c["funcs"]]) for c in whole["classes"]] == [("Cart", ["Cart.size"])]
    add = whole["funcs"][0]
    want = {(r.kind, r.name): [[p.type, round(p.score, 3)] for p in r.predictions] for r in found if r.file == "a.py" and r.scope == "add"}
    assert add["params_p"] == {n: want["Parameter", n] for n in ("left", "right")} and add["ret_type_p"] == want["Return", "add"] and add["variables_p"] == {"total": want["Variable", "total"]}


def test_documents_keep_the_golden_layout(spark, tmp_path):
    """What is written back is what the reader of module documents flattens."""
    rows = [("m.py", "", "module", "Variable", "v", 1, [("int", 0.12345), ("str", 2.68e-11)], None), ("m.py", "A", "class", "Variable", "c", 2, [("str", 1.0)], None), ("m.py", "A.f", "function", "Parameter", "a", 3, [("int", 1.0)], None), ("m.py", "A.f", "function", "Return", "f", 3, [], None)]
    kind = "file string, scope string, level string, kind string, name string, line int, predictions array<struct<type:string,score:double>>, error string"
    text = infer.module_documents(spark.createDataFrame(rows, kind)).first().module
    (tmp_path / "m.json").write_text(text)
    got = {(r.scope, r.kind, r.name, r.type, r.score) for r in corpus.flattened_predictions(corpus.module_document(spark, f"file://{tmp_path}/m.json")).collect()}
    assert got == {("", "var", "v", "int", 0.123), ("", "var", "v", "str", 0.0), ("A", "var", "c", "str", 1.0), ("A.f", "param", "a", "int", 1.0)}


def test_imports_allow_types(spark):
    sources = spark.createDataFrame([("a.py", SOURCE), ("b.py", None)], "file string, text string")
    got = {r.file: set(r.imports or ()) for r in infer.imported(sources).collect()}
    assert got == {"a.py": {"os", "Basket", "Item", "Thing"}, "b.py": set()}


def test_annotations_go():
    source = "x: int\ny: int = 1\nclass A:\n    z: str\n    def f(self, a: int, *b: str) -> int:\n        c: int = a\n        return c\n"
    assert extract.without_annotations(source) == "y = 1\n\nclass A:\n\n    def f(self, a, *b):\n        c = a\n        return c"
    assert extract.without_annotations("class A:\n    z: str\n") == "class A:\n    pass"


def test_checked_predictions(spark, built, tmp_path):
    """A checker of our own objects to every annotation ``str``."""
    kind = "file string, scope string, level string, kind string, name string, line int, predictions array<struct<type:string,score:double>>, error string"
    rows = [("a.py", "add", "function", "Parameter", "left", 1, [("str", 0.6), ("int", 0.4)], None), ("a.py", "add", "function", "Return", "add", 1, [("int", 1.0)], None)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/inferred")
    sources = spark.createDataFrame([("a.py", "def add(left: int, right):\n    return left\n"), ("b.py", "y = 1\n")], "file string, text string")
    script = "import re, sys; n = len(re.findall('[:>] str', open(sys.argv[1]).read())); [print('x [misc]') for _ in range(n)]; print('Success: none' if not n else f'Found {n} errors in 1 file (checked 1 source file)'); sys.exit(bool(n))"
    ratios = {r.kind: (r.passed, r.total) for r in jobs.check_job(spark, sources, str(tmp_path), ("python", "-c", script)).collect()}
    assert ratios == {"p_equal_gt": (1, 1), "p_not_equal_gt": (0, 1), "p_wo_gt": (1, 1)}
    texts = {r.file: r.text for r in spark.read.parquet(f"{tmp_path}/typed").collect()}
    # All but the annotation is as it was, byte for byte.
    assert texts == {"a.py": "def add(left: int, right) -> int:\n    return left\n", "b.py": "y = 1\n"}
    listed = spark.createDataFrame([("a.py", 0, "str"), ("a.py", 0, "int")], "file string, place int, type string")
    assert [r.type for r in typecheck.without_failing(listed, spark.read.parquet(f"{tmp_path}/verdicts")).collect()] == ["int"]


def test_failing_trial_stays_without_restore(spark):
    """Without restoring, a failed prediction stays in the slot and spoils the later ones."""
    script = "import re, sys; n = len(re.findall(': bad', open(sys.argv[1]).read())); [print('x [misc]') for _ in range(n)]; print('Success: none' if not n else f'Found {n} errors in 1 file (checked 1 source file)'); sys.exit(bool(n))"
    text = "def f(a, b):\n    return a\n"
    rows = spark.createDataFrame([("m.py", text, "f.a", "", ["int", "bad"]), ("m.py", text, "f.b", "", ["int"])], "file string, text string, slot string, truth string, predictions array<string>")
    for restore, want in ((True, [True, False, True]), (False, [True, False, False])):
        got = typecheck.greedy_verdicts(rows, ("python", "-c", script), restore=restore).orderBy("place").collect()
        assert [r.is_tc for r in got] == want


def test_vote_decodes(spark):
    near = spark.createDataFrame([(1, 10, 0, 1.0, 1), (1, 11, 1, 2.0, 2)], "query_id long, item_id long, label int, dist double, rn int")
    codes = spark.createDataFrame([("int", 0), ("str", 1)], "type string, code long")
    got = infer.ranked(None, near, codes).first()
    assert [(p.type, round(p.score, 6)) for p in got.predictions] == [("int", 0.8), ("str", 0.2)]
    assert isinstance(knn.cells_for(10), int) and bundle.Bundle.__dataclass_fields__["k"].default == 10


def test_live_inference(spark, built, tmp_path):
    from slotloom.streaming import service

    (tmp_path / "in").mkdir()
    for i in range(2):
        spark.createDataFrame([(f"f{i}.py", f"def f{i}(a):\n    return a\n")], "file string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/w{i}")
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
    stream = spark.readStream.schema("file string, text string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    service.annotated_batches(stream, built[2], f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", filter_types=False).start().awaitTermination()
    got = {(r.file, r.kind, r.name): len(r.predictions) > 0 for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {(f"f{i}.py", kind, name): True for i in range(2) for kind, name in (("Parameter", "a"), ("Return", f"f{i}"))}
