"""Readers and writers of project documents, tables and logs, and the streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from slotloom.functions import text
from slotloom.operators import evaluate, infer, typecheck
from slotloom.plans import jobs
from slotloom.sources import corpus, tables
from slotloom.streaming import admission, service

MODULE = {
    "variables": {"limit": "int"}, "mod_var_occur": {"limit": [["limit", "max"]]}, "imports": ["os"], "set": "train",
    "funcs": [{"name": "add", "q_name": "add", "params": {"a": "int", "args": "", "b": ""}, "params_occur": {"a": [["total", "a"]], "b": []}, "params_descr": {"a": "left"}, "docstring": {"func": "Adds."}, "ret_exprs": ["return total"], "ret_type": "int", "variables": {"total": ""}, "fn_var_occur": {"total": [["total", "a", "b"]]}}],
    "classes": [{"name": "C", "q_name": "C", "variables": {"kind": "str"}, "cls_var_occur": {"kind": [["self", "kind"]]}, "funcs": [{"name": "get", "q_name": "C.get", "params": {"self": ""}, "params_occur": {}, "params_descr": {}, "ret_exprs": [], "ret_type": "", "variables": {}, "fn_var_occur": {}}]}],
}


@pytest.fixture
def projects(tmp_path):
    paths = []
    for i, name in enumerate(("ann/one", "bob/two", "cid/three")):
        path = tmp_path / f"p{i}.json"
        path.write_text(json.dumps({name: {"src_files": {f"{name}/m.py": MODULE}}}))
        paths.append(f"file://{path}")
    return paths


def test_project_documents(spark, projects):
    modules = corpus.project_documents(spark, projects, limit=2)
    assert {(r.project, r.file) for r in modules.collect()} == {("ann/one", "ann/one/m.py"), ("bob/two", "bob/two/m.py")}
    with pytest.raises(ValueError):
        corpus.project_documents(spark, [])
    functions = {r.name: r for r in corpus.function_rows(modules.where("project = 'ann/one'")).collect()}
    add = functions["add"]
    assert (add.author, add.repo, add.set, add.func_descr, add.return_type, add.return_expr) == ("ann", "one", "train", "Adds.", "int", ["return total"])
    assert dict(zip(add.arg_names, zip(add.arg_types, add.arg_descrs, add.args_occur))) == {"a": ("int", "left", ["total a"]), "args": ("", "", []), "b": ("", "", [])}
    assert functions["get"].arg_names == ["self"] and functions["get"].return_expr == []
    variables = {(r.var_name, r.var_type): r.var_occur for r in corpus.variable_rows(modules.where("project = 'ann/one'")).collect()}
    assert variables == {("limit", "int"): ["limit max"], ("kind", "str"): ["self kind"], ("total", ""): ["total a b"]}


def test_slots_of_documents(spark, projects):
    modules = corpus.project_documents(spark, projects[:1]).select("file", "module")
    got = {(r.scope, r.level, r.kind, r.name, r.annotation, tuple(r.occurrences)) for r in infer.slots_of_documents(modules).collect()}
    assert got == {
        ("", "module", "Variable", "limit", "int", ("limit max",)), ("C", "class", "Variable", "kind", "str", ("self kind",)), ("add", "function", "Variable", "total", "", ("total a b",)),
        ("add", "function", "Parameter", "a", "int", ("total a",)), ("add", "function", "Parameter", "b", "", ()), ("add", "function", "Return", "add", "int", ("return total",)),
    }
    points = infer.placed(infer.datapoints(infer.slots_of_documents(modules), 3), stop_words=("a", "the")).where("name = 'total'").first()
    assert points.identifiers[:1] == ["total"] and len(points.identifiers) == 31 and points.tokens[:3] == ["total", "b", ""] and points.hint == 3


def test_tables_of_text(spark, tmp_path):
    rows = spark.createDataFrame([("f", 'says "x"\nand y', "nan"), ("g", None, "int")], "name string, func_descr string, return_type string")
    corpus.write_csv(rows, f"file://{tmp_path}/csv")
    got = {r.name: (r.func_descr, r.return_type) for r in corpus.read_csv(spark, f"file://{tmp_path}/csv", rows.schema).collect()}
    assert got == {"f": ('says "x"\nand y', None), "g": (None, "int")}
    visible = spark.createDataFrame([(t,) for t in ("Foo", "Bar", "Foo", "int")], "type string")
    corpus.write_frequencies(spark.createDataFrame([(t,) for t in ("str", "int", "str")], "type string"), visible, f"file://{tmp_path}/lists", top_n=2)
    read = lambda name: [tuple(r) for r in spark.read.option("header", "true").csv(f"file://{tmp_path}/lists/{name}").collect()]
    assert read("most_frequent_all_types") == [("1", "str", "2"), ("0", "int", "1")] and read("top_visible_types") == [("Foo", "2"), ("Bar", "1")]
    (tmp_path / "types").mkdir()
    (tmp_path / "types" / "a.txt").write_text("Foo\nBar\n")
    (tmp_path / "types" / "deeper").mkdir()
    (tmp_path / "types" / "deeper" / "b.txt").write_text("Baz\n")
    assert sorted(r.type for r in corpus.visible_types(spark, f"file://{tmp_path}/types").collect()) == ["Bar", "Foo"]


def test_repositories(spark):
    files = spark.createDataFrame([("ann", "one", "ann/one/a.py"), ("ann", "one", "ann/one/b.py"), ("ann", ".git", "ann/.git/c.py"), (".x", "y", ".x/y/z.py"), ("bob", "loose.py", "bob/loose.py")], "author string, repo string, file string")
    assert [tuple(r) for r in corpus.repositories(files).collect()] == [("ann", "one")]


def test_jdbc_round_trip(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    corpus.append_jdbc(rows, url, "requests", **driver)
    corpus.append_jdbc(rows.where("id = 1"), url, "requests", **driver)
    assert sorted(tuple(r) for r in corpus.jdbc_table(spark, url, "requests", **driver).collect()) == [(1, "x"), (1, "x"), (2, "y")]


def test_written_tables(spark):
    rows = spark.range(5)
    again = tables.written(rows, "five")
    assert again.count() == 5 and "Range" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_job_log(spark, tmp_path):
    out = f"file://{tmp_path}"
    with jobs.logged(spark, out, "extract"):
        pass
    with pytest.raises(KeyError), jobs.logged(spark, out, "learn"):
        raise KeyError("x")
    got = {r.phase: r.error for r in spark.read.json(f"{out}/logs").collect()}
    assert got == {"extract": None, "learn": "KeyError: 'x'"}


def test_requests_at_once(spark):
    counts = []
    assert jobs.requests_at_once(lambda i: counts.append(spark.range(i).count()), 4) > 0 and sorted(counts) == [0, 1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        jobs.requests_at_once(lambda i: 1 / i, 2)


@pytest.mark.parametrize(("word", "want"), [("boxes", "box"), ("classes", "class"), ("queries", "query"), ("names", "name"), ("status", "status"), ("bus", "bus"), ("pass", "pass")])
def test_lemma(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(text.lemma(F.col("w"))).first()[0] == want


def test_sentence(spark):
    row = spark.createDataFrame([("getTheUserNames2_of boxes", None)], "a string, b string").select(text.sentence(F.col("a"), ("the", "of")), text.sentence(F.col("b"), ("the",))).first()
    assert tuple(row) == ("get user name box", "")


def test_warnings_are_counted(spark):
    rows = spark.createDataFrame([("a", 1, ["a:1: warning: w", "a:2: error: e  [misc]", "Found 1 error in 1 file (checked 1 source file)"])], "file string, retcode int, lines array<string>")
    got = typecheck.parsed(rows).first()
    assert (got.n_errors, got.n_warnings, got.breakdown) == (1, 1, {"[misc]": 1})


def test_code_metrics(spark):
    rows = spark.createDataFrame([(0, [1, 0]), (0, [1, 2]), (5, [5]), (7, [1, 2, 7]), (7, [])], "label int, predicted array<int>")
    common = spark.createDataFrame([(5,)], "label int")
    got = evaluate.code_metrics(rows, (0,), common, top_n=2).first()
    assert (got.n, got.exact_all, got.exact_ubiquitous, got.exact_common, got.exact_rare) == (5, 40.0, 50.0, 100.0, 0.0)
    empty = evaluate.code_metrics(rows.limit(0), (0,), common).first()
    assert empty.n == 0 and empty.exact_all is None
    names = spark.createDataFrame([(0, "List[int]"), (1, "List[str]"), (2, "list"), (3, "int")], "code int, type string")
    listed = spark.createDataFrame([(1, 0, [3, 1]), (2, 0, [3]), (3, 0, [2]), (4, 3, [3]), (5, 0, [])], "id int, label int, predicted array<int>")
    assert {r.id: r.match for r in evaluate.parametric_code_matches(listed, names).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


# -- streams ----------------------------------------------------------------------------------------------------------


def arriving(spark, tmp_path, batches, schema):
    """A stream that gets one file per batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{i}")
        found = next((tmp_path / f"in{i}").glob("*.parquet"))
        (tmp_path / "arriving").mkdir(exist_ok=True)
        found.rename(tmp_path / "arriving" / f"{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/arriving")


def test_rate_limit_over_batches(spark, tmp_path):
    schema = "user_id int, ts timestamp, event_id long"
    import datetime

    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    batches = [[(1, at(1, 5), 10), (1, at(1, 3), 11), (2, at(1, 1), 12)], [(1, at(1, 6), 13), (1, at(2, 1), 14)], [(1, at(1, 7), 15), (2, at(1, 9), 16), (2, at(1, 8), 17)]]
    stream = arriving(spark, tmp_path, batches, schema)
    got = {r.event_id: r.admitted for r in admission.run_to_table(service.admitted_stream(stream, 2, "day"), "limits", "append").collect()}
    assert got == {10: True, 11: True, 12: True, 13: False, 14: True, 15: False, 16: False, 17: True}


def test_rate_limit_state_is_bounded(spark, tmp_path, monkeypatch):
    import datetime

    monkeypatch.setattr(service, "WINDOWS_HELD", 2)
    assert service.WINDOWS_HELD == 2
    rows = [(1, datetime.datetime(2024, 1, d, 1), d) for d in (1, 2, 3)]
    stream = arriving(spark, tmp_path, [rows, [(1, datetime.datetime(2024, 1, 3, 2), 4)]], "user_id int, ts timestamp, event_id long")
    got = {r.event_id: r.admitted for r in admission.run_to_table(service.admitted_stream(stream, 1, "day"), "bounded", "append").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_acceptances_join_requests_over_batches(spark, tmp_path):
    import datetime

    at = lambda minute: datetime.datetime(2024, 1, 1, 5) + datetime.timedelta(minutes=minute)
    (tmp_path / "a").mkdir()
    (tmp_path / "r").mkdir()
    accepted = arriving(spark, tmp_path / "a", [[("s", at(10), 1)], [("s", at(80), 2), ("t", at(20), 3)]], "sess_id string, timestamp timestamp, accepted long")
    requests = arriving(spark, tmp_path / "r", [[("s", at(0), 7)], [("t", at(30), 8)]], "sess_id string, start_t timestamp, request long")
    got = {(r.accepted, r.request) for r in admission.run_to_table(service.joined_acceptances(accepted, requests).select("accepted", "request"), "joined", "append").collect()}
    assert got == {(1, 7)}


def test_appended_batches(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[(1, "10.0.0.1")], [(2, "10.0.0.2")]], "id int, ip string")
    log = f"file://{tmp_path}/log"
    for _ in range(2):  # a second run finds nothing new
        service.append_batches(service.logged_requests(stream), log, f"file://{tmp_path}/checkpoint").start().awaitTermination()
    got = {(r.id, r.epoch) for r in spark.read.parquet(log).collect()}
    assert got == {(1, 0), (2, 1)}


def test_acceptance_log_and_telemetry(spark, tmp_path):
    requests = spark.createDataFrame([("s",)], "sess_id string")
    accepted = spark.createDataFrame([("s", "int"), ("x", "str")], "sess_id string, accepted_type string")
    for _ in range(2):
        service.append_acceptances(accepted, requests, f"file://{tmp_path}/accepted")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/accepted").select("sess_id", "accepted_type").collect()] == [("s", "int")] * 2
    sent = service.telemetry(spark.createDataFrame([("s", "ok", None), ("t", None, "bad")], "sess_id string, response string, error string"))
    assert [tuple(r) for r in sent.collect()] == [("ok", None, "s"), (None, "bad", None)]
    late = service.latency(spark.sql("select timestamp'2024-01-01 00:00:00' start_t, timestamp'2024-01-01 00:00:01.5' finished_t")).first()
    assert math.isclose(late.latency_s, 1.5)
