"""Scope analysis, definitions of one name, lossless annotation and trials of predictions."""

import ast
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.operators import edits, extract, infer, scopes, typecheck
from slotloom.plans import modules

OVERLOADS = "from typing import overload\n\n@overload\ndef f(b: int, a: int) -> int: ...\n@overload\ndef f(b: str, a: str) -> str: ...\ndef f(b, a):\n    return a\n\n\nclass C:\n    @property\n    def p(self) -> int:\n        return self.v\n    @p.setter\n    def p(self, v):\n        self.v = v\n\n\nif f:\n    class C:\n        w = 1\n        def q(self, x):\n            return x\n"


@pytest.mark.parametrize("number", range(len(modules.MODULES)))
def test_modules(number):
    want = sorted(r for r in modules.slot_rows() if r[0] == number)
    assert sorted((number, s.scope, s.kind, s.name, s.annotation, s.line, s.at, s.owner) for s in extract.slots_of(modules.MODULES[number][0])) == want


def test_uses_follow_scopes():
    source = "x = 1\ndef f(x):\n    return x\ndef g():\n    y = x\n    def h():\n        return y\n    return [x for x in y]\nclass A:\n    x = 2\n    def m(self):\n        return x, self.x\n"
    uses = {(s.scope, s.kind, s.name): s.occurrences for s in extract.slots_of(source)}
    assert uses["", "Variable", "x"] == ["x", "y x", "x self x"]  # not the parameter, not the comprehension's own
    assert uses["f", "Parameter", "x"] == ["x"] and uses["g", "Variable", "y"] == ["y x", "y", "x x y"]
    assert uses["A", "Variable", "x"] == ["x", "x self x"]


def test_analysis_is_linear():
    source = "def f():\n" + "".join(f"    v{i} = v{max(0, i - 1)} + 1\n" for i in range(2000))
    began = time.process_time()
    assert len(extract.slots_of(source)) == 2000
    assert time.process_time() - began < 1


def test_imports():
    source = '"""\nfrom here we import nothing\n"""\nfrom shop import (\n    Basket,\n    Item as Thing,  # Not this\n)\nif x:\n    import a.b as c, d\n    from e import *\n'
    assert scopes.imported_names(source) == ["Basket", "Item", "Thing", "a.b", "c", "d"]
    assert scopes.imported_names("import (") == []


def test_table_function_takes_lines_in_any_order(spark):
    extract.register(spark)
    rows = [(f, i, line) for f, text in (("a.py", OVERLOADS), ("b.py", "x = (\n1)"), ("c.py", "def (")) for i, line in enumerate(text.split("\n"))]
    spark.createDataFrame(rows[::-1], "file string, line int, text string").repartition(5).createOrReplaceTempView("lines_of_files")
    got = spark.sql("SELECT * FROM source_slots(TABLE(lines_of_files) PARTITION BY file ORDER BY line)").collect()
    assert {r.file: r.error for r in got} == {"a.py": None, "b.py": None, "c.py": "SyntaxError"}
    whole = extract.extracted(spark.createDataFrame([("a.py", OVERLOADS)], "file string, text string")).collect()
    assert sorted(tuple(map(str, r)) for r in got if r.file == "a.py") == sorted(tuple(map(str, r)) for r in whole)


def test_each_definition_is_a_slot_of_its_own(spark):
    slots = extract.extracted(spark.createDataFrame([("a.py", OVERLOADS)], "file string, text string"))
    points = infer.datapoints(slots, 0).collect()
    assert len({r.id for r in points}) == len(points) == slots.count()
    # In the order of the source, and of the same definition only.
    assert {tuple(r.arguments) for r in points if r.function == "f"} == {("b", "a")}
    words = spark.createDataFrame([("f", [1.0, 2.0]), ("a", [3.0, 4.0])], "word string, vector array<float>")
    placed = infer.placed(infer.datapoints(slots, 0)).select("id", "identifiers", "tokens")
    assert infer.matrices(placed, words, 2).count() == len(points)
    # A repeated id doesn't end the job either.
    again = placed.unionByName(placed)
    assert infer.matrices(again.limit(3), words, 2).count() > 0
    documents = infer.module_documents(slots.selectExpr("*", "array(named_struct('type', 'int', 'score', 0.25D)) as predictions"))
    module = json.loads(documents.first().module)
    assert [sorted(f["params_p"]) for f in module["funcs"]] == [["a", "b"]] * 3 and ["ret_type_p" in f for f in module["funcs"]] == [False, False, True]
    assert [(c["q_name"], sorted(c["variables_p"]), [(f["name"], sorted(f["params_p"])) for f in c["funcs"]]) for c in module["classes"]] == [("C", ["v"], [("p", []), ("p", ["v"])]), ("C", ["w"], [("q", ["x"])])]


GOLDEN = {
    "variables_p": {"limit": [["int", 0.75], ["str", 0.25]]},
    "classes": [{"name": "Cart", "q_name": "Cart", "variables_p": {"kind": [["str", 1.0]], "owner": []}, "funcs": [{"name": "size", "q_name": "Cart.size", "params_p": {"item": [["Item", 0.5]]}, "variables_p": {}, "ret_type_p": [["int", 0.125]]}]}],
    "funcs": [{"name": "add", "q_name": "add", "params_p": {"left": [["int", 1.0]], "right": [["int", 1.0]]}, "variables_p": {"total": []}, "ret_type_p": [["int", 1.0]]}, {"name": "empty", "q_name": "empty", "params_p": {"a": []}, "variables_p": {}}],
}


def test_documents_have_the_layout_of_the_service(spark):
    """Nothing is changed or moved before the comparison."""
    source = "limit = 3\n\ndef add(left, right):\n    total = left + right\n    return total\n\nclass Cart:\n    kind = 'x'\n    def size(self, item):\n        self.owner = item\n        return item\n\ndef empty(a):\n    pass\n"
    answers = {"limit": [("int", 0.75), ("str", 0.25)], "kind": [("str", 1.0)], "item": [("Item", 0.5)], "size": [("int", 0.125)], "left": [("int", 1.0)], "right": [("int", 1.0)], "add": [("int", 1.0)]}
    told = spark.createDataFrame(list(answers.items()), "n string, predictions array<struct<type:string,score:double>>")
    slots = extract.extracted(spark.createDataFrame([("a.py", source)], "file string, text string"))
    rows = slots.join(told, slots["name"] == told["n"], "left").selectExpr("file", "scope", "level", "kind", "name", "line", "at", "owner", "place", "coalesce(predictions, array()) as predictions", "error")
    assert json.loads(infer.module_documents(rows).first().module) == GOLDEN


def test_small_tables_of_sources_are_spread(spark):
    """A table of one partition isn't parsed in one task, and files don't go to Python one by one."""
    sources = spark.createDataFrame([(f"{i}.py", f"def f{i}(a):\n    return a\n") for i in range(64)], "file string, text string").coalesce(1)
    for df in (extract.extracted(sources), extract.untyped(sources), infer.imported(sources)):
        assert sum(1 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) > 4
    told = F.array(F.struct(F.lit("int").alias("type"), F.lit(0.12345).alias("score")), F.struct(F.lit("str").alias("type"), F.lit(0.1).alias("score")))
    documents = infer.module_documents(extract.extracted(sources).withColumn("predictions", F.when(F.col("kind") == "Return", told).otherwise(F.slice(told, 1, 0))))
    assert "FlatMapGroupsInPandas" not in documents._jdf.queryExecution().executedPlan().toString()
    assert {r.file: json.loads(r.module)["funcs"] for r in documents.collect()} == {f"{i}.py": [{"name": f"f{i}", "q_name": f"f{i}", "params_p": {"a": []}, "variables_p": {}, "ret_type_p": [["int", 0.123], ["str", 0.1]]}] for i in range(64)}


def test_the_walk_is_that_of_the_library():
    skipped = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
    for source in [text for text, _ in modules.MODULES] + [open(ast.__file__).read()]:
        tree = ast.parse(source)
        assert [n for n in scopes.walked(tree) if not isinstance(n, skipped)] == [n for n in ast.walk(tree) if not isinstance(n, skipped)]
    names = ["a", "a.b.c", "(a)", "a().b", "List[int]", "'x'"]
    assert [scopes.text_of(ast.parse(n, mode="eval").body) for n in names] == [ast.unparse(ast.parse(n, mode="eval").body) for n in names]


def test_annotations_are_spread(spark):
    sources = spark.createDataFrame([(f"{i}.py", f"def f{i}(a):\n    return a\n") for i in range(64)], "file string, text string").coalesce(1)
    found = edits.annotated_sources(sources, sources.selectExpr("file", "0 as place", "'int' as annotation"))
    for df in (found, edits.restored(found.coalesce(1))):
        assert sum(1 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) > 4


# -- edits ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_edits_keep_all_other_bytes(ending):
    for text, _ in modules.MODULES:
        source = edits.Annotator(text.replace("\n", ending))
        found = source.edits({p: "Dict[str, 'ä']" for p in source.names})
        new, back = edits.apply_edits(source.source, found)
        assert edits.undone(new, back) == source.source
        after = edits.Annotator(new)
        assert sum(a == "Dict[str, 'ä']" for _, _, a in after.names.values()) == len(found)
        bare, back = source.bare()
        assert edits.undone(bare, back) == source.source and len(edits.Annotator(bare).names) == len(source.names)


def test_annotations_go_in_and_out(spark):
    text = "# c\ndef f(a ,  # d\n      b=1) :\n    x = a;  (y) = b\n    for z in a: pass\n    return (a,\n            b)\n"
    source = edits.Annotator(text)
    by_name = {(k, n): p for p, (k, n, _) in source.names.items()}
    new = source.annotated({by_name[k]: "T" for k in by_name})
    assert new == "# c\ndef f(a: T ,  # d\n      b: T=1) -> T :\n    x: T = a;  (y) = b\n    for z in a: pass\n    return (a,\n            b)\n"
    assert edits.Annotator(new).bare()[0] == text
    rows = spark.createDataFrame([("a", text), ("bad", "def ("), ("null", None), ("none", "x = 1\n")], "file string, text string")
    wanted = spark.createDataFrame([("a", by_name["Parameter", "a"], "T"), ("a", 99, "T"), ("bad", 0, "T"), ("null", 0, "T"), ("none", 0, "not a type")], "file string, place int, annotation string")
    found = edits.annotated_sources(rows, wanted)
    got = {r.file: r.text for r in found.collect()}
    assert got == {"a": text.replace("a ,", "a: T ,"), "bad": "def (", "null": None, "none": "x = 1\n"}
    assert {r.file: r.text for r in edits.restored(found).collect()} == {"a": text, "bad": "def (", "null": None, "none": "x = 1\n"}


# -- trials -----------------------------------------------------------------------------------------------------------

#: Fails for ``bad``, ends with code 2 for ``crash``, and counts errors that aren't included for ``other``.
CHECKER = "import sys; t = open(sys.argv[1]).read(); 'crash' in t and (print('internal error: usage'), sys.exit(2)); n = t.count('bad'); m = t.count('other'); [print('x [misc]') for _ in range(n)]; [print('x [import]') for _ in range(m)]; print('Success: none' if not n + m else f'Found {n + m} errors in 1 file (checked 1 source file)'); sys.exit(bool(n + m))"


def test_a_broken_checker_passes_nothing():
    assert typecheck.passes("ran", 0, ["Success: no issues found in 1 source file"])
    assert typecheck.passes("ran", 1, ["a.py:1: error: x  [import]", "Found 1 error in 1 file (checked 1 source file)"])
    for run in (("ran", 2, ["internal error: usage"]), ("ran", 0, []), ("ran", 0, ["Found it"]), ("ran", 1, ["Success: x"]), ("timeout", -1, []), ("ran", 1, ["a.py:1: error: x  [misc]", "Found 1 error in 1 file (checked 1 source file)"])):
        assert not typecheck.passes(*run)


def test_trials_follow_the_order_of_the_document_and_put_the_truth_back(spark):
    text = "class A:\n    k = 1\n    def m(self, p: int): return p\n\ndef f(a, b: str = ''):\n    v = a\n    return v\nlast = 1\n"
    sources = spark.createDataFrame([("m.py", text), ("other.py", "x = 1\n")], "file string, text string")
    slots = extract.extracted(sources).where("file = 'm.py'")
    tried = {"k": ["int", "bad"], "p": ["crash", "other"], "m": ["int"], "a": ["bad", "int"], "b": ["str", "no type"], "v": ["crash"], "f": ["other"], "last": ["int"]}
    told = spark.createDataFrame(list(tried.items()), "n string, predictions array<string>")
    rows = slots.join(told, slots["name"] == told["n"]).select("file", "place", slots["annotation"].alias("truth"), typecheck.trial_order().alias("trial"), "predictions")
    found = typecheck.slot_verdicts(sources, rows, ("python", "-c", CHECKER))
    names = {r.place: r.name for r in slots.collect()}
    got = [(names[r.place], r.prediction, r.kind, r.is_tc) for r in found.orderBy("step").collect()]
    assert got == [
        ("last", "int", "p_wo_gt", True), ("a", "bad", "p_wo_gt", False), ("a", "int", "p_wo_gt", True), ("b", "str", "p_equal_gt", True), ("b", "no type", "p_not_equal_gt", False), ("v", "crash", "p_wo_gt", False), ("f", "other", "p_wo_gt", True),
        ("k", "int", "p_wo_gt", True), ("k", "bad", "p_wo_gt", False), ("p", "crash", "p_not_equal_gt", False), ("p", "other", "p_not_equal_gt", True), ("m", "int", "p_wo_gt", True),
    ]
    # What the last trial of each slot left: the ground truth after a failure.
    texts = {r.file: r.text for r in typecheck.applied(sources, found).collect()}
    assert texts == {"m.py": "class A:\n    k = 1\n    def m(self, p: other) -> int: return p\n\ndef f(a: int, b: str = '') -> other:\n    v = a\n    return v\nlast: int = 1\n", "other.py": "x = 1\n"}


def test_greedy_verdicts_put_the_truth_back(spark):
    rows = spark.createDataFrame([("m.py", "def f(a, b):\n    return a\n", "f.a", "", ["int", "bad"]), ("m.py", "def f(a, b):\n    return a\n", "f.b", "", ["int"])], "file string, text string, slot string, truth string, predictions array<string>")
    found = typecheck.greedy_verdicts(rows, ("python", "-c", CHECKER))
    sources = rows.select("file", "text").distinct()
    assert typecheck.typed_sources(sources, found).first().text == "def f(a, b: int):\n    return a"


def test_vectors_of_repeated_ids(spark):
    from slotloom.operators import features

    rows = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "")], "id long, sequence string")
    words = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vector array<float>")
    got = {(r.id, tuple(np.ravel(r.matrix))) for r in features.vectorised(rows, words, 2, 1).collect()}
    assert got == {(1, (2.0, 2.0)), (2, (0.0, 0.0))}
