"""Queries over the operators that write, fold, register, stage and decode, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions import folds, scalars
from weirflow.operators import payloads, registry, sinks, stages, tables
from weirflow.operators.flow import apply, chain, failures, results, task
from weirflow.operators.shards import Shard, write_shard
from weirflow.plans.catalogue import query
from weirflow.plans.compiler import Codec, compile_spec
from weirflow.sources import inputs, reads
from weirflow.spec import QuerySpec
from weirflow.streaming import resume

# -- reads ----------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000")
def count_rows(t, spark):
    return spark.createDataFrame([(reads.count(spark, t, QuerySpec("orders", filters={"o_totalprice__gt": 100000}, order=("o_orderkey",))),)], "n long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def rows_read(t, spark):
    got = reads.rows(spark, t, QuerySpec("nation", fields=("n_nationkey", "n_name"), filters={"n_regionkey": 2}))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in got], "n_nationkey int, n_name string")


@query("SELECT n_nationkey, (n_nationkey // 4)::BIGINT AS page FROM nation")
def pages_read(t, spark):
    got = [(r["n_nationkey"], k) for k, page in enumerate(reads.pages(t("nation").select("n_nationkey"), "n_nationkey", 4)) for r in page]
    return spark.createDataFrame(got, "n_nationkey int, page long")


@query("SELECT c_name, (SELECT c_custkey FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 1 OFFSET 9) AS following FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 10")
def page_cursor(t, spark):
    got, following = reads.page_with_cursor(t("customer"), "c_custkey", 20, 10, fields=("c_name",))
    return spark.createDataFrame([(r["c_name"], following) for r in got], "c_name string, following long")


@query("SELECT count(*)::BIGINT AS n, (SELECT min(s_name) FROM supplier WHERE s_suppkey = 3) AS one FROM supplier")
def selection_read(t, spark):
    suppliers = t("supplier").select("s_suppkey", "s_name")
    one = reads.Selection(suppliers.where("s_suppkey = 3")).one()["s_name"]
    return spark.createDataFrame([(reads.Selection(suppliers).count(), one)], "n long, one string")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 AND user_id > 5")
def where_python(t, spark):
    return reads.where_python(t("events").select("event_id", "user_id"), lambda r: r["event_id"] % 3 == 0 and r["user_id"] > 5)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 2)")
def db_input(t, spark):
    return inputs.project_table("supplier", columns=("s_suppkey", "s_name"), where={"s_nationkey__in": [1, 2]}).frame(spark, {"project": t})


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def inline_input(t, spark):
    wire = inputs.to_wire(inputs.inline_items([{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3, "name": None}], "id long, name string"))
    return inputs.from_wire(wire).frame(spark)


@query("SELECT n::BIGINT AS n, (n // 4)::BIGINT AS chunk FROM range(10) r(n) WHERE n >= 4")
def source_resumed(t, spark):
    source = inputs.Source(range(10), "n long", {"taken": 4}, chunk=4)
    out = [df.withColumn("chunk", F.lit(k + 1).cast("long")) for k, df in enumerate(source.frames(spark))]
    return out[0].union(out[1])


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 7")
def journal_recorded(t, spark):
    return inputs.recorded(t("events").select("event_id"), 7, "event_id")


@query("SELECT event_id AS \"index\", '{\"attempt\":' || (event_id % 3) || ',\"index\":' || event_id || '}' AS value FROM events WHERE event_id % 4 <> 0")
def part_results(t, spark):
    text = F.concat(F.lit('{"index":'), F.col("event_id"), F.lit(',"attempt":'), F.col("event_id") % 3, F.lit("}"))
    old = F.concat(F.lit('{"index":'), F.col("event_id"), F.lit(',"attempt":-1}'))
    lines = t("events").select(F.explode(F.array(text, old)).alias("value"), "event_id")
    cut = lines.withColumn("value", F.when(F.col("event_id") % 4 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")))
    return inputs.part_results(cut.select("value"))


# -- filters of the second dialect and coded columns --------------------------------


def _coded(t):
    return lambda name: t(name).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)) if name == "orders" else t(name)


_STATUS = Codec(lambda v: {"F": 1, "O": 2, "P": 3}.get(v), lambda c: F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), c))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderstatus <> 'P'")
def coded_filter(t, spark):
    return compile_spec(QuerySpec("orders", fields=("o_orderkey", "o_orderstatus"), filters={"o_orderstatus__in": ["F", "P"], "o_orderstatus__ne": "P"}), _coded(t), spark, {"o_orderstatus": _STATUS})


def _null_status(t):
    return lambda name: t(name).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))) if name == "orders" else t(name)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def model_none(t, spark):
    return compile_spec(QuerySpec("orders", fields=("o_orderkey",), filters={"o_orderstatus": None}), _null_status(t), spark, mode="model")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def model_subquery(t, spark):
    sub = QuerySpec("orders", fields=("o_custkey",), filters={"o_orderstatus__ne": None})
    return compile_spec(QuerySpec("customer", fields=("c_custkey",), filters={"c_custkey__in_subquery": sub}), _null_status(t), spark, mode="model")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 30")
def model_order(t, spark):
    return compile_spec(QuerySpec("part", fields=("p_partkey", "p_size"), order=("-p_size", " ", "p_partkey"), limit=30), t, spark, mode="model")


# -- writes -------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_nationkey * 2 AS doubled, CASE WHEN n_nationkey >= 20 THEN 'late' ELSE 'auto' END AS tag FROM nation")
def table_append(t, spark):
    table = tables.Table(spark, tables.scratch(spark, "append"), "n_nationkey int, n_name string, tag string", computed={"doubled": F.col("n_nationkey") * 2}, defaults={"tag": "auto"}, checks={"a name": F.col("n_name") != ""})
    ledger = tables.Table(spark, tables.scratch(spark, "ledger"), "sink_key string, commit_key string, row_count long")
    sink = tables.TableSink(table, ledger=ledger)
    nations = t("nation").select("n_nationkey", "n_name")
    for commit in ("first", "first"):  # the second is known already
        sink.write(nations.where("n_nationkey < 20").withColumn("doubled", F.lit(0)), commit)
    sink.write(nations.where("n_nationkey >= 20").withColumn("tag", F.lit("late")), "second")
    return table.read()


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'new', NULL")
def table_upsert(t, spark):
    table = tables.Table(spark, tables.scratch(spark, "upsert"), "n_nationkey int, n_name string, n_regionkey int", keys=("n_nationkey",))
    table.insert(t("nation"))
    new = t("nation").where("n_nationkey % 5 = 0").select("n_nationkey", F.lit("renamed").alias("n_name"))
    tables.persist(new.union(spark.createDataFrame([(100, "new")], "n_nationkey int, n_name string")), tables.TableSink(table, "upsert"))
    return table.read()


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 AND s_suppkey <= (SELECT max(s_suppkey) FROM (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5 ORDER BY s_suppkey LIMIT 2)) THEN 'first' ELSE s_name END AS s_name FROM supplier WHERE s_nationkey <> 7")
def table_update_delete(t, spark):
    table = tables.Table(spark, tables.scratch(spark, "update"), "s_suppkey long, s_name string, s_nationkey int", keys=("s_suppkey",))
    table.insert(t("supplier").select("s_suppkey", "s_name", "s_nationkey"))
    table.update({"s_name": "first"}, F.col("s_nationkey") < 5, limit=2)
    table.delete(F.col("s_nationkey") == 7)
    table.vacuum()
    return table.read().select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def table_codec(t, spark):
    encode = lambda c: F.when(c == "F", 1).when(c == "O", 2).otherwise(3)
    table = tables.Table(spark, tables.scratch(spark, "codec"), "o_orderkey long, o_orderstatus int", codecs={"o_orderstatus": (encode, _STATUS)})
    table.insert(t("orders").select("o_orderkey", "o_orderstatus"))
    return table.read()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def file_sink(t, spark):
    sink = tables.FileSink(tables.scratch(spark, "files"), per_batch=True)
    nations = t("nation").select("n_nationkey", "n_name")
    paths = [sink.write(nations.where(f"n_nationkey % 2 = {k}"), k) for k in (0, 1, 1)]  # a batch again replaces itself
    return spark.read.schema("n_nationkey long, n_name string").json(paths[:2])


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 6 <> 5")
def deliver_groups(t, spark):
    table = tables.Table(spark, tables.scratch(spark, "deliver"), "n_nationkey int")

    def write(rows):
        if not rows.where("n_nationkey % 6 = 5").isEmpty():
            raise ValueError("a bad row")
        table.insert(rows)

    tables.deliver(t("nation").select("n_nationkey"), write, "n_nationkey", groups=1)
    return table.read()


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN -1 WHEN l_orderkey % 3 = 1 THEN NULL ELSE p.id END AS order_id FROM lineitem JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders) p ON l_orderkey = o_orderkey")
def explicit_fk(t, spark):
    orders = t("orders").select(F.col("o_orderkey").alias("element"), F.lit("o").alias("ref"), F.col("o_orderkey").alias("seq"))
    kind = F.col("l_orderkey") % 3
    ref = F.when(kind == 0, "unknown").when(kind == 2, "o")
    lines = t("lineitem").select(F.col("l_orderkey").alias("element"), F.lit(None).cast("string").alias("ref"), F.monotonically_increasing_id().alias("seq"), ref.alias("order_ref"), F.when(kind == 0, F.lit(-1).cast("long")).alias("order_id"), "l_orderkey", "l_linenumber", "l_partkey")
    made = sinks.write_graph({"orders": orders, "lines": lines}, [sinks.Relation("orders", "lines", "order_id", "order_ref")])
    return made["lines"].select("l_orderkey", "l_linenumber", "l_partkey", "order_id")


@query("WITH n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation), f AS (SELECT n_regionkey, min(n_nationkey) AS k FROM nation GROUP BY 1) SELECT r_name, n.id AS first_nation FROM region LEFT JOIN f ON r_regionkey = f.n_regionkey LEFT JOIN n ON n.n_nationkey = f.k")
def deferred_fk(t, spark):
    first = t("nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    regions = t("region").join(first, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.lit(1).alias("element"), F.concat(F.lit("r"), "r_regionkey").alias("ref"), F.col("r_regionkey").cast("long").alias("seq"), F.concat(F.lit("n"), "k").alias("first_ref"), "r_name")
    nations = t("nation").select(F.lit(1).alias("element"), F.concat(F.lit("n"), "n_nationkey").alias("ref"), F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("r"), "n_regionkey").alias("region_ref"))
    relations = [sinks.Relation("regions", "nations", "region_id", "region_ref"), sinks.Relation("nations", "regions", "first_nation", "first_ref", deferred=True)]
    return sinks.write_graph({"regions": regions, "nations": nations}, relations)["regions"].select("r_name", "first_nation")


@query("SELECT * FROM (VALUES (0::BIGINT, 'molecules'), (1, 'ligands'), (2, 'receptors'), (3, 'complexes')) v(place, node)")
def graph_order(t, spark):
    relations = [sinks.Relation("molecules", "receptors", "m", "r"), sinks.Relation("molecules", "ligands", "m", "r"), sinks.Relation("receptors", "complexes", "r", "r"), sinks.Relation("ligands", "complexes", "l", "r"), sinks.Relation("complexes", "molecules", "c", "r", deferred=True)]
    got = sinks.topological(["complexes", "ligands", "molecules", "receptors"], relations)
    return spark.createDataFrame(list(enumerate(got)), "place long, node string")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'auto' WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name FROM customer")
def column_defaults(t, spark):
    has = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c_custkey"))).otherwise(F.array(F.lit("c_custkey"), F.lit("c_name")))
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), has.alias("has"))
    return sinks.with_defaults(rows, {"c_name": "auto"}).select("c_custkey", "c_name")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def shard_lookup(t, spark):
    path = tables.scratch(spark, "shard")
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.encode("s_name", "UTF-8").alias("record"))
    write_shard(rows, path, "suppliers", 0, 0, 1 << 40, files=4)
    shard = Shard(spark, path, "suppliers")
    assert shard.verify().isEmpty()
    return shard.many(t("supplier").where("s_suppkey % 2 = 0").select("s_suppkey")).select("id", F.decode("record", "UTF-8").alias("name"))


# -- payloads -----------------------------------------------------------------------


def _payloads(t):
    data = F.encode(F.concat(F.lit("part "), F.col("p_partkey")), "UTF-8")
    return t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 12).alias("volume_id"), data.alias("data"), F.when(F.col("p_partkey") % 50 == 0, 0).otherwise(F.crc32(data)).alias("crc"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"))


@query("SELECT 'no_volume' AS fault, p_partkey AS id FROM part WHERE p_partkey % 12 >= 10 UNION ALL SELECT 'unreferenced', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey + 3 FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'empty', v FROM (VALUES (12::BIGINT), (13)) x(v) UNION ALL SELECT 'broken', p_partkey FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT DISTINCT 'dangling', l_partkey + 3 FROM lineitem WHERE l_quantity > 45 AND l_partkey + 3 NOT IN (SELECT p_partkey FROM part)")
def payload_check(t, spark):
    volumes = spark.range(14).where("id < 10 OR id > 11").select(F.col("id").alias("volume_id"))
    refs = t("lineitem").where("l_quantity > 45").select((F.col("l_partkey") + 3).alias("ref"))
    return payloads.check(_payloads(t), volumes, [(refs, "ref")])


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30))")
def payload_release(t, spark):
    ids = t("part").where("p_partkey % 2 = 0").select("p_partkey")
    return payloads.release(_payloads(t), ids, [(t("lineitem").where("l_quantity > 30"), "l_partkey")]).select("id")


@query("SELECT p_partkey AS id, 'part ' || p_partkey AS text FROM part WHERE p_size > 25 AND p_partkey % 10 = 0")
def payload_many(t, spark):
    ids = t("part").where("p_size > 25 AND p_partkey % 10 = 0").select("p_partkey", (-F.col("p_partkey")).alias("seq"))
    return payloads.get_many(_payloads(t), ids, kind="large").select("id", F.decode("data", "UTF-8").alias("text"))


@query("SELECT c_custkey, c_mktsegment AS text FROM customer")
def payload_put(t, spark):
    empty = spark.createDataFrame([], "id long, data binary, kind string, crc long")
    rows = t("customer").select("c_custkey", F.encode("c_mktsegment", "UTF-8").alias("body"))
    stored, swapped = payloads.put(empty, rows, "body", "segment")
    return payloads.enrich(swapped, stored, ["body_id"]).select("c_custkey", F.decode("body_id_data", "UTF-8").alias("text"))


@query("SELECT s_suppkey AS volume_id FROM supplier WHERE s_acctbal > 5000 OR s_suppkey < 5")
def volumes_to_compact(t, spark):
    stats = t("supplier").select(F.col("s_suppkey").alias("volume_id"), F.when(F.col("s_acctbal") > 5000, 0.5).otherwise(0.1).alias("dead_share"), F.when(F.col("s_suppkey") < 5, 10).otherwise(1 << 30).alias("size"))
    return payloads.to_compact(stats).select("volume_id")


@query("SELECT p_partkey AS id, s_name AS series FROM part JOIN supplier ON p_partkey % 12 = s_suppkey")
def payload_volumes(t, spark):
    return payloads.located(_payloads(t), t("supplier").select(F.col("s_suppkey").alias("volume_id"), F.col("s_name").alias("series"))).select("id", "series")


# -- registry -----------------------------------------------------------------------


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) + 100)::BIGINT AS id, s_name AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'available' END AS status FROM supplier UNION ALL SELECT 100, 'old', 'available'")
def artifact_register(t, spark):
    old = spark.createDataFrame([(100, "old", "available")], "id long, path string, status string")
    return registry.register(old, t("supplier").select(F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, "failed").alias("status"), F.col("s_suppkey").alias("seq")))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN 'stale' ELSE 'available' END AS status, CASE WHEN s_nationkey = 3 THEN '{\"a\":1,\"b\":\"new\",\"n\":' || s_nationkey || '}' ELSE '{\"b\":\"old\",\"n\":' || s_nationkey || '}' END AS metadata_json FROM supplier")
def artifact_update(t, spark):
    meta = F.concat(F.lit('{"b":"old","n":'), F.col("s_nationkey"), F.lit("}"))
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("available").alias("status"), meta.alias("metadata_json"), "s_nationkey")
    return registry.update_artifact(rows, F.col("s_nationkey") == 3, "stale", '{"a": 1, "b": "new"}').drop("s_nationkey")


@query("SELECT n_regionkey AS scope, max(n_nationkey) AS state FROM nation GROUP BY n_regionkey")
def scope_state(t, spark):
    rows = t("nation").select(F.col("n_regionkey").alias("scope"), F.col("n_nationkey").alias("state"), F.array(F.lit("scope"), F.lit("state")).alias("has"), F.col("n_nationkey").alias("seq"))
    return registry.record_scope_state(spark.createDataFrame([], "scope int, state int"), rows, ["scope"])


@query("SELECT c_custkey AS id, c_custkey IN (3, 5) AS favorite FROM customer WHERE c_custkey % 2 = 1")
def project_prune(t, spark):
    projects = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.lit(None).cast("boolean").alias("favorite"))
    marked = registry.toggled(projects, [3, 5])
    return registry.pruned(marked, t("customer").where("c_custkey % 2 = 1").select(F.col("c_name").alias("path"))).select("id", F.coalesce("favorite", F.lit(False)).alias("favorite"))


# -- folds and sets -------------------------------------------------------------------


@query("SELECT o_custkey AS job, max(o_totalprice) AS wall, round(sum(o_totalprice), 2) AS cpu, max(o_orderkey) AS slots, max(o_orderkey % 10) AS memory FROM orders GROUP BY o_custkey")
def accounting_fold(t, spark):
    steps = t("orders").select(F.col("o_custkey").alias("job"), F.col("o_totalprice").alias("wall"), F.col("o_totalprice").alias("cpu"), F.col("o_orderkey").alias("slots"), (F.col("o_orderkey") % 10).alias("memory"))
    return folds.accounting(steps).withColumn("cpu", F.round("cpu", 2))


@query("SELECT c_nationkey AS node, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS partitions, max(c_custkey) AS slots FROM customer GROUP BY c_nationkey")
def node_fold(t, spark):
    rows = t("customer").select(F.col("c_nationkey").alias("node"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "*").otherwise("")).alias("partition"), F.col("c_custkey").alias("slots"))
    return folds.nodes(rows).withColumn("partitions", F.concat_ws(",", "partitions"))


@query("SELECT user_id AS job, count(*) FILTER (event_type = 'click')::BIGINT AS done, count(*) FILTER (event_type = 'view')::BIGINT AS failed, 0::BIGINT AS running, count(*)::BIGINT AS total, round(count(*) FILTER (event_type IN ('click', 'view')) / count(*), 8) AS progress FROM events GROUP BY user_id")
def job_progress(t, spark):
    status = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "view", "failed").otherwise("queued")
    return folds.progress(t("events").select(F.col("user_id").alias("job"), status.alias("status"))).withColumn("progress", F.round("progress", 8))


@query("SELECT p_partkey, p_size FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey) ON p_partkey = l_partkey ORDER BY q NULLS LAST, p_size, p_partkey LIMIT 150")
def ranked_order(t, spark):
    ranks = t("lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    return folds.by_rank(t("part").select("p_partkey", "p_size"), ranks, "p_partkey", "q", ["p_size", "p_partkey"]).limit(150)


@query("SELECT 'job' || (o_custkey % 20) AS stem, max(o_orderkey) AS attempt, 'job' || (o_custkey % 20) || '-' || max(o_orderkey) AS name FROM orders GROUP BY o_custkey % 20")
def newest_attempt(t, spark):
    return folds.newest_attempt(t("orders").select(F.concat(F.lit("job"), F.col("o_custkey") % 20, F.lit("-"), "o_orderkey").alias("name")))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS ready FROM lineitem GROUP BY l_orderkey")
def ready_subset(t, spark):
    flags = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.select("l_orderkey", folds.has_all(F.col("flags"), ["A", "R"]).alias("ready"))


@query("SELECT o_orderkey AS job, CASE WHEN o_orderkey % 4 = 0 THEN 'live' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1, 'live'")
def live_jobs(t, spark):
    recorded = t("orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"))
    live = recorded.where("job % 4 = 0").withColumn("status", F.lit("live")).union(spark.createDataFrame([(-1, "live")], "job long, status string"))
    return folds.live_over_recorded(live, recorded, "job")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_elements(t, spark):
    return resume.keyed(t("documents").select("lang", "source")).select("lang", "source")


@query("SELECT user_id AS job, count(*) FILTER (event_id % 3 = 0)::BIGINT AS done, count(*) FILTER (event_id % 3 = 1)::BIGINT AS failed, count(*)::BIGINT AS total FROM events GROUP BY user_id")
def ledger_progress(t, spark):
    status = F.when(F.col("event_id") % 3 == 0, "done").when(F.col("event_id") % 3 == 1, "failed").otherwise("queued")
    return resume.progress(t("events").select(F.col("user_id").alias("job"), status.alias("status")))


# -- tasks and stages -------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS _key, o_orderkey % 3 = 0 AS missing, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 9007199254740993 END AS v FROM orders")
def task_nulls(t, spark):
    rows = t("orders").select(F.col("o_orderkey").alias("_key"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 9007199254740993).alias("v"))
    return results(apply(rows, task(lambda e: {"missing": e["v"] is None, "v": e["v"]}), "missing boolean, v bigint"))


@query("SELECT o_orderkey::VARCHAR AS _key, 'ValueError: ' || o_orderkey AS error, 3 AS attempts FROM orders WHERE o_orderkey % 10 = 0")
def task_retries(t, spark):
    def check(items, least):
        for e in items:
            if e["k"] % least == 0:
                raise ValueError(str(e["k"]))
        return [{"ok": True} for _ in items]

    work = task(check, batched=True, retries=2, params_model=lambda least="10": {"least": int(least)})
    rows = t("orders").where("o_orderkey % 10 = 0 OR o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("_key"), F.col("o_orderkey").alias("k"))
    return failures(apply(rows, work, "ok boolean"))


@query("SELECT o_orderkey::VARCHAR AS _key, 'half' AS node, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 END AS v, CASE WHEN o_orderkey % 2 = 1 THEN 'ValueError: odd' END AS error FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'next', CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 + 1 END, CASE WHEN o_orderkey % 2 = 1 THEN 'skipped' END FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'same', o_orderkey, NULL FROM orders")
def chain_errors(t, spark):
    def half(e, previous):
        if e["k"] % 2:
            raise ValueError("odd")
        return {"v": e["k"] // 2}

    steps = chain({"half": half, "next": lambda e, p: {"v": p["half"]["v"] + 1}, "same": lambda e, p: {"v": e["k"]}}, needs={"next": "half"}, on_error="row")
    rows = t("orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderkey").alias("k"))
    return results(apply(rows, steps, "node string, v bigint, error string"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def stage_top(t, spark):
    def price(e):
        if e["o_orderkey"] % 7 == 0:
            raise ValueError("a bad element")
        return {"o_orderkey": e["o_orderkey"], "o_totalprice": e["o_totalprice"]}

    make = lambda: t("orders").select(F.col("o_orderkey").alias("_key"), "o_orderkey", "o_totalprice")
    plan = [
        stages.Stage("orders", make),
        stages.Stage("prices", task(price), after=("orders",), schema="o_orderkey bigint, o_totalprice double"),
        stages.Stage("top", lambda p: p.select("o_orderkey", "o_totalprice"), after=("prices",), schema="o_orderkey bigint, o_totalprice double", reduce=stages.top(25, "o_totalprice", "o_orderkey")),
    ]
    campaign = stages.Campaign(spark, tables.scratch(spark, "campaign"), plan)
    campaign.run()
    return campaign.rows("top").select("o_orderkey", "o_totalprice")


@query("SELECT * FROM (VALUES ('nations', 'skipped', 'done'), ('broken', 'failed', 'failed'), ('later', 'blocked', 'blocked'), ('reader', 'skipped', 'done')) v(stage, again, first)")
def stage_states(t, spark):
    def fail(df):
        raise ValueError("no")

    plan = [
        stages.Stage("reader", lambda: t("region"), reads=("n",)),
        stages.Stage("nations", lambda: t("nation"), writes=("n",)),
        stages.Stage("broken", fail, after=("nations",)),
        stages.Stage("later", lambda df: df, after=("broken",)),
    ]
    path = tables.scratch(spark, "states")
    first, again = (stages.Campaign(spark, path, plan).run() for _ in range(2))
    return spark.createDataFrame([(k, first[k]["status"], again[k]["status"]) for k in first], "stage string, first string, again string")


# -- scalars ----------------------------------------------------------------------------


@query("SELECT s_suppkey, 'dock-R' || s_suppkey || '-' || s_name AS label, sha256(length(s_name) || ':' || s_name || '-') AS identity, substr(sha256(s_name || '|' || s_suppkey || '|' || s_nationkey), 1, 16) AS stage_key, to_base64(s_name::BLOB) AS base64 FROM supplier")
def names_and_keys(t, spark):
    c = {k: F.col(k) for k in ("s_suppkey", "s_name")}
    return t("supplier").select("s_suppkey", scalars.label("dock-R{s_suppkey}-{s_name}", c).alias("label"), scalars.identity(F.col("s_name"), F.lit(None)).alias("identity"), scalars.stage_key(F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey")).alias("stage_key"), F.base64(F.encode("s_name", "UTF-8")).alias("base64"))


@query("SELECT p_partkey, least(greatest(ceil(p_size / 8), 1), 5)::BIGINT AS units, (p_size * 3 + 2)::BIGINT AS gpus, (p_partkey * 60 + 5)::BIGINT AS seconds, (greatest(ceil((p_partkey * 60 + 5) * 1.5 / 60), 1) * 60)::BIGINT AS scaled, p_size * 1024.0::DOUBLE AS megabytes, p_size % 2 = 0 AS truth FROM part")
def sizes_and_times(t, spark):
    size = F.col("p_size").cast("string")
    duration = F.concat(F.floor(F.col("p_partkey") / 1440), F.lit("-"), F.lpad(F.floor(F.col("p_partkey") % 1440 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit(":05"))
    seconds = scalars.seconds(duration)
    return t("part").select(
        "p_partkey", scalars.units(F.col("p_size"), 8, 5).alias("units"), scalars.gpus(F.concat(F.lit("cpu=4,gres/gpu:a100="), size, F.lit(",gpu:2,gres/gpu="), size, F.lit(",gpu:h100:"), size)).alias("gpus"),
        seconds.cast("long").alias("seconds"), scalars.scaled(seconds, 1.5).alias("scaled"), scalars.megabytes(F.concat(size, F.lit("G"))).alias("megabytes"), scalars.truth(F.when(F.col("p_size") % 2 == 0, " Yes ").otherwise("no")).alias("truth"),
    )


@query("SELECT p_partkey, '.gz' AS suffix, p_partkey AS part, p_brand AS \"partition\", replace(replace(p_name, 'e', '3'), 'a', '4') AS text, '1970-01-01T00:00:' || lpad((p_partkey % 60)::VARCHAR, 2, '0') || '.000Z' AS at FROM part")
def paths_and_marks(t, spark):
    path = F.concat(F.lit("out/run.x/part_"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".GZ"))
    return t("part").select("p_partkey", scalars.suffix(path).alias("suffix"), scalars.part_number(path).alias("part"), scalars.partition_name(F.concat("p_brand", F.lit("*"))).alias("partition"), scalars.replaced(F.col("p_name"), {"e": "3", "a": "4"}).alias("text"), scalars.iso(F.timestamp_seconds(F.col("p_partkey") % 60)).alias("at"))


@query("SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"type\":\"' || event_type || '\"}' AS merged FROM events")
def json_merge(t, spark):
    return t("events").select("event_id", scalars.merged_json(F.col("props"), F.concat(F.lit('{"type":"'), "event_type", F.lit('"}'))).alias("merged"))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"user_id\":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE user_id::VARCHAR END || '}' AS canonical FROM events")
def canonical_json(t, spark):
    rows = t("events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"))
    return rows.select("event_id", scalars.canonical("user_id", "event_id").alias("canonical"))


@query("SELECT p_partkey, substr(p_name, 3, 4) AS part, p_size * 2.0::DOUBLE * 4 AS wait FROM part")
def slices_and_waits(t, spark):
    return t("part").select("p_partkey", F.decode(scalars.slice_bytes(F.encode("p_name", "UTF-8"), F.lit(2), F.lit(4)), "UTF-8").alias("part"), scalars.waits(F.col("p_size") * 2.0, F.lit(3)).alias("wait"))
