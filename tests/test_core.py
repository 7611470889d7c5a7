import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalars
from weirflow.operators import payloads, sinks
from weirflow.operators.flow import apply, failures, results, task
from weirflow.plans.compiler import Codec, compile_spec
from weirflow.sources.reads import MultipleResultsFound, NoResultFound, Rows, Selection, batches, pages, where_python
from weirflow.spec import QuerySpec, identifier, order_terms
from weirflow.streaming.resume import content_key, keyed, run_available


@pytest.fixture(scope="module")
def tables(spark):
    t = {
        "t": spark.createDataFrame([(1, "a%b", '{"k": {"n": 3}}', 1), (2, "A_c\\", '{"k": {"n": "3"}}', 2), (3, None, '{"k": {"n": true}}', None), (4, "xAy", "no json", 1)], "id long, name string, js string, code int"),
        "s": spark.createDataFrame([(1,), (None,)], "id long"),
        "empty": spark.createDataFrame([], "id long"),
    }
    return t.__getitem__


def ids(spark, tables, mode="spec", codecs={}, **filters):
    return sorted(r["id"] for r in compile_spec(QuerySpec("t", filters=filters), tables, spark, codecs, mode).collect())


def test_identifiers_and_order():
    assert order_terms(["-a", " ", "b.c"]) == (("a", False), ("b.c", True))
    for bad in ("a b", "1a", "a;b", "a\\b", ""):
        with pytest.raises(ValueError):
            identifier(bad)
    with pytest.raises(ValueError):
        QuerySpec("t", query="SELECT 1")
    assert QuerySpec("t", limit=-3, offset=-1).limit == 0


def test_spec_round_trip():
    q = QuerySpec("t", ("id",), {"id__gt": 1, "id__in_subquery": [QuerySpec("s", ("id",))]}, ("-id",), 5)
    again = QuerySpec.from_json(q.to_json())
    assert again.fields == q.fields and again.filters["id__in_subquery"][0].table == "s"


def test_null_rules_of_the_dialects(spark, tables):
    assert ids(spark, tables, name=None) == []
    assert ids(spark, tables, mode="model", name=None) == [3]
    assert ids(spark, tables, mode="model", name__ne=None) == [1, 2, 4]
    assert ids(spark, tables, name__ne="xAy") == [1, 2]
    assert ids(spark, tables, name__is_null=False) == [1, 2, 4]


def test_patterns_fold_case_and_keep_wildcards(spark, tables):
    assert ids(spark, tables, name__contains="a") == [1, 2, 4]
    assert ids(spark, tables, name__startswith="a_") == [1, 2]
    assert ids(spark, tables, name__endswith="\\") == [2]


def test_json_is_typed(spark, tables):
    assert ids(spark, tables, **{"js->k->n": 3}) == [1]
    assert ids(spark, tables, **{"js->k->n": "3"}) == [2]


def test_literals_that_do_not_fit(spark, tables):
    assert ids(spark, tables, id="x") == []
    assert ids(spark, tables, id="2") == [2]


def test_null_safe_membership(spark, tables):
    sub = lambda t: QuerySpec(t, ("id",))
    assert ids(spark, tables, code__not_in_subquery=sub("s")) == [2]
    assert ids(spark, tables, code__not_in_subquery=sub("empty")) == [1, 2, 3, 4]
    assert ids(spark, tables, code__in_subquery=sub("s")) == [1, 4]
    with pytest.raises(ValueError):
        ids(spark, tables, id__in_subquery=QuerySpec("s"))
    with pytest.raises(ValueError):
        ids(spark, tables, id__near=3)


def test_codecs(spark, tables):
    codec = {"code": Codec({"one": 1, "two": 2}.get, lambda c: F.when(c == 1, "one").when(c == 2, "two"))}
    assert ids(spark, tables, codecs=codec, code="one") == [1, 4]
    got = compile_spec(QuerySpec("t", ("id", "code"), order=("id",)), tables, spark, codec).collect()
    assert [r["code"] for r in got] == ["one", "two", None, "one"]


def test_reads(spark):
    df = spark.range(10)
    assert [len(p) for p in pages(df, "id", 4)] == [4, 4, 2]
    rows = Rows(df, QuerySpec("t"), "id")
    it = iter(rows)
    next(it)
    assert rows.state == {"cap": 9, "after": 0} and rows.remaining() == 9
    later = Rows(spark.range(20), QuerySpec("t"), "id", dict(rows.state))
    assert [r["id"] for r in later] == list(range(1, 10))
    assert Rows(df.limit(0), QuerySpec("t"), "id").remaining() == 0
    with pytest.raises(ValueError):
        Rows(df, QuerySpec("t", limit=1), "id")
    with pytest.raises(ValueError):
        next(pages(df.union(df), "id", 3))
    with pytest.raises(MultipleResultsFound):
        Selection(df).one()
    with pytest.raises(NoResultFound):
        Selection(df.limit(0)).one()
    assert Selection(df.limit(0)).first() is None
    assert [list(r["items"]) for r in batches(df, 4, "id").orderBy("batch").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert where_python(df, lambda r: r["id"] % 4 == 1).count() == 3


def test_upsert_keeps_what_a_row_does_not_carry(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "z", None, ["x"], 1), (1, None, None, ["y"], 2), (3, "n", 9, ["x"], 3), (1, None, 7, ["y"], 4)], "k int, x string, y int, has array<string>, seq int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "z", 7), (2, "b", 2), (3, "n", None)}
    with pytest.raises(ValueError):
        sinks.upsert(old, new.withColumn("k", F.lit(None).cast("int")), ["k"])


def test_defaults_fill_missing_not_null(spark):
    df = spark.createDataFrame([(None, ["x"]), (None, [])], "x int, has array<string>")
    assert [r["x"] for r in sinks.with_defaults(df, {"x": 5}).collect()] == [None, 5]


def test_graph(spark):
    parents = spark.createDataFrame([(1, "p", 0), (2, "p", 1)], "element int, ref string, seq int")
    kids = spark.createDataFrame([(1, None, 0, "p", None), (2, None, 1, "p", 77), (2, None, 2, None, None)], "element int, ref string, seq int, pref string, parent_id long")
    rel = sinks.Relation("parents", "kids", "parent_id", "pref")
    made = sinks.write_graph({"kids": kids, "parents": parents}, [rel])
    assert [r["parent_id"] for r in made["kids"].orderBy("seq").collect()] == [1, 77, None]
    with pytest.raises(ValueError, match="unknown"):
        sinks.write_graph({"kids": kids.withColumn("pref", F.lit("q")), "parents": parents}, [rel])
    with pytest.raises(ValueError, match="twice"):
        sinks.write_graph({"kids": kids.where("element = 1"), "parents": parents.withColumn("element", F.lit(1))}, [rel])
    with pytest.raises(ValueError, match="cycle"):
        sinks.topological(["a", "b"], [sinks.Relation("a", "b", "x", "y"), sinks.Relation("b", "a", "x", "y")])
    assert sinks.topological(["b", "a", "c"], [sinks.Relation("c", "a", "x", "y")]) == ["b", "c", "a"]


def test_tasks(spark):
    df = spark.range(6).selectExpr("id AS _key", "id")
    flaky = task(lambda e, by: [{"v": int(e["id"]) * by}] * 2 if e["id"] % 3 else 1 / 0, retries=1)
    out = apply(df, flaky, "v bigint", {"by": 10})
    assert sorted(r["v"] for r in results(out).collect()) == [10, 10, 20, 20, 40, 40, 50, 50]
    assert {(r["_key"], r["attempts"]) for r in failures(out).collect()} == {("0", 2), ("3", 2)}


def test_content_keys_and_resume(spark, tmp_path):
    a = spark.createDataFrame([(1, None)], "x int, y string")
    b = a.select("y", "x")
    assert a.select(content_key(a)).first()[0] == b.select(content_key(b)).first()[0]
    assert keyed(a.union(a)).count() == 1
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        run_available(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 5


def test_payloads(spark):
    p = spark.createDataFrame([(1, b"abc"), (2, b"xyz")], "id long, data binary").withColumn("crc", F.crc32("data"))
    rows = spark.createDataFrame([(10, 1), (11, None)], "r long, pid long")
    got = {r["r"]: r["pid_data"] for r in payloads.enrich(rows, p, ["pid"]).collect()}
    assert bytes(got[10]) == b"abc" and got[11] is None
    assert [r["id"] for r in payloads.unreferenced(p, [(rows, "pid")]).collect()] == [2]
    with pytest.raises(KeyError):
        payloads.get_many(p, spark.createDataFrame([(9,)], "id long"))
    assert payloads.broken(p.withColumn("crc", F.lit(0))).count() == 2 and payloads.broken(p).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(" a,b ,, a", "1-02:03:04", "4G", "Yes ", '{"a": "1", "b": "2"}', '{"b": "3"}')], "t string, d string, m string, b string, o string, n string")
    r = df.select(scalars.tags(F.col("t")), scalars.seconds(F.col("d")), scalars.megabytes(F.col("m")), scalars.truth(F.col("b")), scalars.merged_json(F.col("o"), F.col("n"))).first()
    assert tuple(r) == ("a, b", 93784, 4096.0, True, '{"a":"1","b":"3"}')
