"""Written tables, shards, stages, inputs and settings beyond what SQL can say."""

import pytest
from pyspark.sql import functions as F

from weirflow import settings
from weirflow.functions import folds
from weirflow.operators import payloads, registry, tables
from weirflow.operators.flow import apply, autobatch, chain, failures, results, task
from weirflow.operators.shards import Shard, write_shard
from weirflow.operators.stages import Campaign, Fold, Stage, order_of
from weirflow.sources import inputs
from weirflow.sources.reads import numbered
from weirflow.spec import QuerySpec


def test_tables_refuse_what_they_cannot_hold(spark, tmp_path):
    table = tables.Table(spark, str(tmp_path / "t"), "id long, name string", keys=("id",), checks={"a name": F.col("name").isNotNull()})
    assert table.read().isEmpty() and table.versions() == []
    table.insert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
    with pytest.raises(ValueError, match="a name"):
        table.insert(spark.createDataFrame([(3, None)], "id long, name string"))
    with pytest.raises(ValueError, match="unknown columns"):
        table.insert(spark.createDataFrame([(3, "c", 1)], "id long, name string, more int"))
    rows = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "id long, name string, seq int")
    table.upsert(rows, seq="seq")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "y")] and sorted(map(tuple, table.read(1).collect())) == [(1, "a"), (2, "b")]
    assert table.delete(F.col("id") == 9) == 0 and table.versions() == [1, 2] and table.vacuum() == [1]
    with pytest.raises(ValueError):
        tables.TableSink(table, "other")
    with pytest.raises(ValueError):
        tables.FileSink("x", "json", append=True)


def test_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(k, f"mol-{k}".encode()) for k in (105, 100, 103)], "id long, record binary")
    assert write_shard(rows, path, "d", 1, 100, 10)["slot_count"] == 6
    shard = Shard(spark, path, "d")
    assert len(shard) == 3 and 103 in shard and 104 not in shard and shard[105] == b"mol-105" and [k for k, _ in shard] == [100, 103, 105]
    with pytest.raises(KeyError):
        shard[104]
    with pytest.raises(ValueError):
        Shard(spark, path, "other")
    for bad in (rows.union(rows), rows.withColumn("id", F.col("id") + 10)):
        with pytest.raises(ValueError):
            write_shard(bad, path, "d", 1, 100, 10)
    shard.df = shard.df.withColumn("record", F.when(F.col("id") == 103, F.lit(b"x")).otherwise(F.col("record")))
    assert [r["id"] for r in shard.verify().collect()] == [103]


def test_stages(spark, tmp_path):
    with pytest.raises(ValueError, match="cycle"):
        order_of([Stage("a", None, after=("b",)), Stage("b", None, after=("a",))])
    with pytest.raises(ValueError, match="unknown"):
        order_of([Stage("a", None, after=("x",))])
    assert [s.name for s in order_of([Stage("a", None), Stage("b", None, priority=1), Stage("c", None, writes=("t",)), Stage("d", None, reads=("t",), priority=9)])] == ["b", "a", "c", "d"]
    square = task(lambda e, by: {"v": e["id"] ** 2 * by} if e["id"] != 3 else 1 / 0)
    total = Fold(lambda: 0, lambda n, r: n + r["v"], lambda a, b: a + b, lambda v: [(v,)])

    def plan(by):
        return [
            Stage("n", lambda: spark.range(6).selectExpr("id AS _key", "id")),
            Stage("square", square, after=("n",), schema="v long", params={"by": by}),
            Stage("sum", lambda df: df.select("v"), after=("square",), schema="v long", reduce=total),
        ]

    ended = []
    first = Campaign(spark, str(tmp_path / "c"), plan(1), ended.append)
    assert [s["status"] for s in first.run().values()] == ["done"] * 3 and ended == [first.states]
    assert first.rows("sum").first()[0] == 0 + 1 + 4 + 16 + 25 and first.errors("square").first()["_key"] == "3"
    changed = Campaign(spark, str(tmp_path / "c"), plan(2))
    assert [s["status"] for s in changed.run().values()] == ["skipped", "done", "done"] and changed.rows("sum").first()[0] == 92


def test_inputs():
    spec = inputs.DbInput(table="t", columns=("a",), where={"a__in": [1, 2]})
    value = {"x": (1, b"\x00\xff"), "y": [spec, inputs.Bytes(b"z")]}
    assert inputs.from_wire(inputs.to_wire(value)) == value and inputs.has_inputs(value) and not inputs.has_inputs({"x": [1]})
    assert spec.spec() == QuerySpec("t", fields=("a",), filters={"a__in": [1, 2]})
    for bad in ({"fields": ("a",), "columns": ("b",)}, {"db_role": "other"}, {"db_role": "custom"}):
        with pytest.raises(ValueError):
            inputs.DbInput(table="t", **bad)
    assert inputs.resolved("a/../b", "project", {"project": "/p/"}) == "/p/b"
    for bad in ("../b", "/b", "a/../../b"):
        with pytest.raises(ValueError):
            inputs.resolved(bad, "project", {"project": "/p"})
    assert list(inputs.simple_items(range(5), 2)) == [[0, 1], [2, 3], [4]] and list(inputs.simple_items("ab")) == ["a", "b"]
    assert inputs.Source([1, 2, 3], "n int", {"taken": 1}).remaining() == 2


def test_settings():
    s = settings.Settings(default={"a": {"x": 1, "y": 2}, "b": 1}, project={"a": {"y": 3}})
    assert s.effective() == {"a": {"x": 1, "y": 3}, "b": 1} and s.source("a.y") == "project" and s.source("a.x") == "default" and s.source("c") is None
    tree = {}
    settings.put(tree, "p.q.r", 1)
    assert settings.get(tree, "p.q.r") == 1 and settings.remove(tree, "p.q.r") and tree == {} and not settings.remove(tree, "p.q")
    assert settings.pruned({"a": {"x": 1, "y": 3}, "b": 1}, {"a": {"x": 1, "y": 2}, "b": 1}) == {"a": {"y": 3}}


def test_numbers_of_sparse_keys(spark):
    keys = [k * k * 1_000_003 for k in range(300)]
    got = numbered(spark.createDataFrame([(k,) for k in reversed(keys)], "k long").repartition(3), "k").collect()
    assert {r["k"]: r["n"] for r in got} == dict(zip(keys, range(300), strict=True))
    assert numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_steps_and_batches(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "_key string, v long")
    closed = chain({"one": lambda e, p: {"n": e["v"] + 1}}, on_error="fail")
    out = apply(df, closed, "node string, n long")
    assert [r["n"] for r in results(out).collect()] == [2] and failures(out).first()["_key"] == "b"
    with pytest.raises(ValueError):
        chain({}, on_error="other")
    timings = spark.createDataFrame([(n, 1 + 0.01 * n) for n in (128, 256, 384)], "n int, seconds double")
    assert autobatch(timings) == 1900
    assert folds.fold(spark.range(100), int, lambda n, r: n + r["id"], lambda a, b: a + b) == 4950
    assert [r["id"] for r in folds.sample(spark.range(50), "id", 3, 7).collect()] == [r["id"] for r in folds.sample(spark.range(50).repartition(5), "id", 3, 7).collect()]


def test_unknown_artifacts_and_kinds(spark):
    artifacts = spark.createDataFrame([(1, "available")], "id long, status string")
    new = spark.createDataFrame([(2, "search")], "artifact_id long, capability string")
    with pytest.raises(ValueError):
        registry.add_capability(new.limit(0), new, artifacts)
    p = spark.createDataFrame([(1, b"a", "x"), (2, b"b", "y")], "id long, data binary, kind string")
    with pytest.raises(KeyError):
        payloads.get_many(p, spark.createDataFrame([(2,)], "id long"), kind="x")
    assert [[k for k, _ in w] for w in payloads.windows(p, window=1)] == [[1], [2]]
    asked = spark.createDataFrame([(2, 0), (1, 1), (2, 2)], "id long, seq int")
    assert [r["id"] for r in payloads.get_many(p, asked).collect()] == [2, 1]
