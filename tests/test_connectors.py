"""Substring postings, request records, tensor files, JDBC and exact admission."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotloom.operators import labels, postings
from slotloom.sources import corpus, records, tensors
from slotloom.streaming import admission


def test_first_containing(spark):
    r = random.Random(0)
    word = lambda n: "".join(r.choice("abAö[]") for _ in range(n))
    ranked = [(word(r.randint(1, 9)), i) for i in range(40)]
    asked = ["", "a", "ö", "zz", "z", None, *(word(r.randint(1, 5)) for _ in range(200)), *(t for t, _ in ranked)]
    got = postings.first_containing(spark.createDataFrame([(s,) for s in asked], "type string"), spark.createDataFrame(ranked, "type string, rank int"))
    want = {s: min(i for t, i in ranked if s in t) for s in asked if s is not None and any(s in t for t, _ in ranked)}
    rows = got.collect()
    assert {x.type: x.rank for x in rows} == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_hints_without_types_or_strings(spark):
    ranked = spark.createDataFrame([("int", 0), ("List[int]", 1)], "type string, rank int")
    asked = spark.createDataFrame([("List",), ("x",), (None,), ("",)], "type string")
    hints = labels.hint_codes(asked, ranked)
    assert {r.type: r.hint for r in hints.collect()} == {"List": 1, "x": 1, "": 0}
    assert "NestedLoop" not in hints._jdf.queryExecution().toString()
    assert labels.hint_codes(asked.limit(0), ranked).count() == 0
    assert {r.hint for r in labels.hint_codes(asked, ranked.limit(0)).collect()} == {-1}


# -- records ----------------------------------------------------------------------------------------------------------


def log(spark, folder, name, low, high):
    spark.range(low, high, 1, 1).selectExpr("id AS event_id", "concat('u', id % 7) AS user", "cast(id AS double) AS unused").coalesce(1).write.parquet(f"{folder}/w-{name}")
    (folder / "log").mkdir(exist_ok=True)
    next((folder / f"w-{name}").glob("*.parquet")).rename(folder / "log" / f"{name}.parquet")


def test_records_are_read_in_ranges(spark, tmp_path):
    spark.dataSource.register(records.RequestRecords)
    log(spark, tmp_path, "a", 0, 100)
    log(spark, tmp_path, "b", 100, 130)
    (tmp_path / "log" / "_hidden.parquet").write_text("no")
    rows = spark.read.format("request_records").schema("user string, event_id long").option("rows", 40).load(str(tmp_path / "log"))
    assert rows.rdd.getNumPartitions() == 4 and sorted((r.event_id, r.user) for r in rows.collect()) == [(i, f"u{i % 7}") for i in range(130)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("request_records").schema("event_id long").load(f"file://{tmp_path}/none").count() == 0


def test_a_restarted_stream_gives_each_record_once(spark, tmp_path):
    spark.dataSource.register(records.RequestRecords)
    stream = lambda: spark.readStream.format("request_records").schema("event_id long, user string").option("rows", 30).load(f"file://{tmp_path}/log")
    path, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    log(spark, tmp_path, "a", 0, 100)
    admission.to_table(stream(), path, checkpoint)
    log(spark, tmp_path, "b", 100, 150)
    log(spark, tmp_path, "c", 150, 151)
    for _ in range(2):
        admission.to_table(stream(), path, checkpoint)
    assert sorted(r.event_id for r in admission.result(stream(), path).collect()) == list(range(151))


# -- tensors ----------------------------------------------------------------------------------------------------------


def test_tensor_files(spark, tmp_path, monkeypatch):
    spark.dataSource.register(tensors.Tensors)
    path = f"file://{tmp_path}/t"
    rows = spark.range(0, 250, 1, 3).selectExpr("id", "cast(id % 2 = 0 as boolean) AS even", "transform(sequence(1, 5), x -> cast(id * x as float)) AS v")
    rows.write.format("tensors").mode("overwrite").save(path)
    rows.where("id < 10").write.format("tensors").mode("append").save(path)
    back = spark.read.format("tensors").option("rows", 20).load(path)
    assert back.schema.simpleString() == rows.schema.simpleString() and back.rdd.getNumPartitions() >= 15
    got = sorted((r.id, r.even, tuple(r.v)) for r in back.collect())
    assert got == sorted([(i, i % 2 == 0, tuple(float(i * x) for x in range(1, 6))) for i in [*range(250), *range(10)]])
    # They are plain tensor files.
    part = next((tmp_path / "t").glob("part-*"))
    assert np.load(part / "2.npy").shape[1] == 5 and np.load(part / "0.npy").dtype == np.int64
    # An overwrite hides what was there; one that fails leaves no parts, and what was there stays.
    rows.where("id = 3").write.format("tensors").mode("overwrite").save(path)
    assert [r.id for r in spark.read.format("tensors").load(path).collect()] == [3]
    before = sorted(p.name for p in (tmp_path / "t").glob("part-*"))
    for broken in (rows.withColumn("v", F.expr("if(id = 200, null, v)")), rows.withColumn("v", F.expr("if(id = 200, slice(v, 1, 2), v)")), rows.withColumn("id", F.col("id").cast("int"))):
        with pytest.raises(Exception, match="nulls|several lengths|another schema"):
            broken.write.format("tensors").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "t").glob("part-*")) == before
    assert spark.read.format("tensors").load(path).count() == 1
    with pytest.raises(Exception, match="no tensors"):
        spark.read.format("tensors").load(f"file://{tmp_path}/nothing")
    rows.limit(0).write.format("tensors").mode("overwrite").save(f"file://{tmp_path}/e")
    assert spark.read.format("tensors").load(f"file://{tmp_path}/e").count() == 0


# -- JDBC -------------------------------------------------------------------------------------------------------------


def test_partitioned_reads_and_epochs(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(0, 100, 1, 4).selectExpr("id", "concat('s', id) AS name")
    for _ in range(2):  # an epoch that runs again adds nothing
        corpus.append_jdbc_epoch(rows, url, "requests", 1, **driver)
    corpus.append_jdbc_epoch(rows.selectExpr("id + 100 AS id", "name"), url, "requests", 2, **driver)
    corpus.append_jdbc_epoch(rows.where("id < 3"), url, "requests", 1, **driver)
    read = corpus.jdbc_partitioned(spark, url, "requests", '"id"', 5, **driver)
    assert read.rdd.getNumPartitions() == 5
    assert sorted((r.id, r.name, r.epoch) for r in read.collect()) == [(i, f"s{i}", 1) for i in range(3)] + [(100 + i, f"s{i}", 2) for i in range(100)]
    corpus.append_jdbc(rows.limit(0), url, "nothing", **driver)
    assert corpus.jdbc_partitioned(spark, url, "nothing", '"id"', 5, **driver).count() == 0


# -- admission --------------------------------------------------------------------------------------------------------


def test_both_limits_over_batches(spark, tmp_path):
    """Files come one after the other; the result is that of all of them in order, and closed windows leave no state."""
    r = random.Random(2)
    events = sorted((r.randrange(3 * 86_400), i, f"c{r.randrange(3)}") for i in range(400))
    for n, lo in enumerate(range(0, 400, 100)):
        part = [(i, c, t) for t, i, c in events[lo : lo + 100]]
        spark.createDataFrame(part, "event_id long, user_id string, s long").selectExpr("event_id", "user_id", "timestamp_seconds(1700006400 + s) AS ts").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    want, hours, days = {}, {}, {}
    for t, i, c in events:
        h, d = (c, (1700006400 + t) // 3600), (c, (1700006400 + t) // 86_400)
        hours[h], days[d] = hours.get(h, 0) + 1, days.get(d, 0) + 1
        want[i] = hours[h] <= 2 and days[d] <= 20
    path, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    for n in range(4):
        import shutil

        (tmp_path / "log").mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / "in" / str(n)).glob("*.parquet")), tmp_path / "log" / f"{n}.parquet")
        stream = spark.readStream.schema("event_id long, user_id string, ts timestamp").parquet(f"file://{tmp_path}/log")
        out = admission.admissions(stream, 2, 20)
        admission.to_table(out, path, checkpoint)
    got = {x.event_id: x.admitted for x in admission.result(out, path).collect()}
    assert got == want
    # Of three days and three clients, a few hours and days are open.
    left = spark.read.format("statestore").option("stateVarName", "counts").load(checkpoint).count()
    assert 0 < left <= 3 * 5


def test_a_batch_touches_the_state_of_a_client_once():
    """However many windows a batch opens: one value, one timer at the first end, and all that ended go together."""

    class State:
        value, calls = None, []

        def get(self):
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        state, timers, changes = State(), set(), 0

        def getValueState(self, *_):
            return self.state

        def registerTimer(self, at):
            self.timers.add(at)
            self.changes += 1

        def deleteTimer(self, at):
            self.timers.remove(at)
            self.changes += 1

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    hour = 3_600_000_000
    handle, limits = Handle(), admission.Admission({"hour": 1, "day": 30})
    limits.init(handle)
    batch = pd.DataFrame({"at": [h * hour + m for h in range(40) for m in (2, 1)], "key": range(80)})
    got = pd.concat(limits.handleInputRows(("c",), iter([batch.iloc[50:], batch.iloc[:50]]), At(0)))
    # The earlier request of each hour, which is the odd one; of a day's requests 30 fit.
    assert dict(zip(got["key"], got["admitted"])) == {k: k % 2 == 1 and (k < 30 or 48 <= k < 78) for k in range(80)}
    assert handle.state.calls == ["update"] and handle.timers == {hour // 1000} and handle.changes == 1
    handle.timers.clear()
    assert list(limits.handleExpiredTimer(("c",), At(30 * hour // 1000), At(hour // 1000))) == []
    assert handle.timers == {31 * hour // 1000} and len(handle.state.value[0]) == 11
    handle.timers.clear()
    list(limits.handleExpiredTimer(("c",), At(48 * hour // 1000), At(48 * hour // 1000)))
    assert handle.state.value is None and not handle.timers
