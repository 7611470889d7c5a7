"""Every query of the catalogue and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import folds, scalars
from weirflow.operators import payloads, registry, sinks
from weirflow.operators.flow import apply, chain, results, task
from weirflow.plans.compiler import compile_spec, parquet_dir
from weirflow.sources import reads
from weirflow.sources.reads import Rows, batches, page_after
from weirflow.spec import QuerySpec
from weirflow.streaming.resume import keyed, remaining

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def spec_query(name: str, sql: str, **spec) -> None:
    """Registers a declarative read."""
    q = QuerySpec(**spec)
    QUERIES[name] = lambda spark, top: compile_spec(q, parquet_dir(spark, top), spark)
    SQL[name] = sql


def query(sql: str | None = None):
    """Registers a function of (tables, spark)."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, top: fn(parquet_dir(spark, top), spark)
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# -- scans, filters, order ------------------------------------------------------

_O = ("o_orderkey", "o_custkey", "o_orderstatus")
_OC = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE "
spec_query("orders_top", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", table="orders", fields=("o_orderkey", "o_totalprice"), filters={"o_orderstatus": "F", "o_totalprice__gte": 100000}, order=("-o_totalprice", "o_orderkey"), limit=100)
spec_query("scan_fields", "SELECT c_custkey, c_name FROM customer", table="customer", fields=("c_custkey", "c_name"))
spec_query("filter_eq", _OC + "o_orderstatus = 'O'", table="orders", fields=_O, filters={"o_orderstatus": "O"})
spec_query("filter_ne", _OC + "o_orderstatus <> 'O'", table="orders", fields=_O, filters={"o_orderstatus__ne": "O"})
spec_query("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_discount >= 0.02 AND l_discount < 0.06", table="lineitem", fields=("l_orderkey", "l_linenumber", "l_quantity"), filters={"l_quantity__gt": 10, "l_quantity__lte": 20, "l_discount__gte": 0.02, "l_discount__lt": 0.06})
spec_query("filter_in", _OC + "o_orderstatus IN ('F', 'P')", table="orders", fields=_O, filters={"o_orderstatus__in": ["F", "P"]})
spec_query("filter_not_in", _OC + "o_orderstatus NOT IN ('F', 'P')", table="orders", fields=_O, filters={"o_orderstatus__not_in": ["F", "P"]})
spec_query("filter_empty_in", _OC + "1 = 0", table="orders", fields=_O, filters={"o_orderstatus__in": []})
spec_query("filter_empty_not_in", _OC + "1 = 1", table="orders", fields=_O, filters={"o_orderstatus__not_in": []})
spec_query("filter_eq_none", _OC + "1 = 0", table="orders", fields=_O, filters={"o_orderstatus": None})
spec_query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%'", table="part", fields=("p_partkey", "p_name"), filters={"p_name__contains": "E"})
spec_query("filter_startswith", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'customer#00000001%'", table="customer", fields=("c_custkey", "c_name"), filters={"c_name__startswith": "customer#00000001"})
spec_query("filter_endswith", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%7'", table="customer", fields=("c_custkey", "c_name"), filters={"c_name__endswith": "7"})
spec_query("filter_text_on_number", _OC + "o_custkey = 7", table="orders", fields=_O, filters={"o_custkey": "7"})
spec_query("filter_json_path", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50", table="events", fields=("event_id",), filters={"props->k__gte": 50})
spec_query("semi_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", table="customer", fields=("c_custkey",), filters={"c_custkey__in_subquery": QuerySpec("orders", fields=("o_custkey",), filters={"o_totalprice__gt": 200000})})
spec_query("anti_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey IS NOT NULL)", table="customer", fields=("c_custkey",), filters={"c_custkey__not_in_subquery": QuerySpec("orders", fields=("o_custkey",), filters={"o_totalprice__gt": 200000})})
spec_query("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25", table="orders", fields=("o_orderkey", "o_totalprice"), order=("-o_totalprice", "o_orderkey"), limit=50, offset=25)


@query("SELECT count(*)::BIGINT AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' LIMIT 500)")
def count_limited(t, spark):
    return spark.createDataFrame([(reads.count(spark, t, QuerySpec("orders", filters={"o_orderstatus": "F"}, limit=500)),)], "n long")


def _some_null(t):
    return lambda name: t(name).withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))) if name == "orders" else t(name)


_NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_totalprice FROM orders)"


@query(f"SELECT o_orderkey, o_custkey FROM {_NULLED} WHERE o_custkey IS NULL")
def filter_is_null(t, spark):
    return compile_spec(QuerySpec("orders", fields=("o_orderkey", "o_custkey"), filters={"o_custkey__is_null": True}), _some_null(t), spark)


@query(f"SELECT o_orderkey, o_custkey FROM {_NULLED} WHERE o_custkey IS NOT NULL")
def filter_is_not_null(t, spark):
    return compile_spec(QuerySpec("orders", fields=("o_orderkey", "o_custkey"), filters={"o_custkey__is_not_null": True}), _some_null(t), spark)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def raw_sql(t, spark):
    t("orders").createOrReplaceTempView("weirflow_orders")
    return compile_spec(QuerySpec(query="SELECT o_orderkey FROM weirflow_orders WHERE o_orderstatus = ? AND o_totalprice > ?", params=("F", 150000)), t, spark)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200")
def keyset_page(t, spark):
    return page_after(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 200)


@query("SELECT event_id, user_id FROM events WHERE event_id <= 5000 AND event_id > 100")
def rows_capped(t, spark):
    events = t("events").select("event_id", "user_id")
    state = {"after": 100}
    Rows(events.where("event_id <= 5000"), QuerySpec("events"), "event_id", state).frame()
    return Rows(events, QuerySpec("events"), "event_id", state).frame()  # rows that came later don't enter


# -- joins, aggregates, windows ---------------------------------------------------


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*)::BIGINT AS n_orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_totalprice >= 50000 GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10")
def nation_revenue(t, spark):
    orders = compile_spec(QuerySpec("orders", fields=("o_custkey", "o_totalprice"), filters={"o_orderstatus": "F", "o_totalprice__gte": 50000}), t, spark)
    both = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n_orders")).orderBy(F.desc("revenue"), "n_name").limit(10)


@query("SELECT o_orderkey, o_custkey, c_name AS o_custkey_data FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_left(t, spark):
    return payloads.enrich(t("orders").select("o_orderkey", "o_custkey"), t("customer"), ["o_custkey"], "c_custkey", "c_name")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(t, spark):
    return sinks.latest(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def capability_ids(t, spark):
    flags = t("lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_returnflag").alias("capability"))
    known = registry.with_capability(flags, "R").withColumnRenamed("artifact_id", "o_orderkey")
    return known.join(t("orders"), "o_orderkey", "left_semi")


@query("SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def artifact_find(t, spark):
    flags = t("lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_returnflag").alias("capability"))
    artifacts = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_custkey", "o_orderpriority")
    return registry.find(artifacts, {"o_orderpriority": "1-URGENT"}, "F", flags, "A").select("id", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def unreferenced_rows(t, spark):
    refs = [(t("orders").where("o_totalprice > 100000"), "o_custkey"), (t("events"), "user_id")]
    return payloads.unreferenced(t("customer"), refs, "c_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) EXCEPT SELECT event_id FROM events WHERE event_type = 'click'")
def set_difference(t, spark):
    have = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")
    return folds.without(have, t("events").where("event_type = 'click'").select("event_id"), "o_orderkey")


@query("SELECT 'order' AS node, o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS name FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_name FROM customer")
def union_nodes(t, spark):
    orders = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    customers = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return folds.union_nodes({"order": orders, "customer": customers})


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_linenumber * 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part_offset FROM lineitem")
def part_offsets(t, spark):
    rows = t("lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey")).withColumn("size", (F.col("l_linenumber") * 10).cast("long"))
    return sinks.prefix_offsets(rows, "l_orderkey", "o", "size").select("l_orderkey", "l_linenumber", "l_partkey", F.col("part_offset").cast("long").alias("part_offset"))


_NEEDLES = "n AS (SELECT DISTINCT l_suppkey AS volume_id, l_partkey AS \"offset\", l_linenumber AS length FROM lineitem), v AS (SELECT s_suppkey AS volume_id, (s_suppkey * 20 + 4000)::BIGINT AS size FROM supplier), g AS (SELECT volume_id, sum(length + 16) AS live, max(\"offset\" + length) AS e FROM n GROUP BY volume_id)"


@query(f"WITH {_NEEDLES} SELECT v.volume_id, size, coalesce(live, 0)::BIGINT AS live_bytes, e::BIGINT AS \"end\", round(1 - coalesce(live, 0) / greatest(size - 32, 1), 4) AS dead_share FROM v LEFT JOIN g ON v.volume_id = g.volume_id")
def dead_share(t, spark):
    needles = t("lineitem").select(F.col("l_suppkey").alias("volume_id"), F.col("l_partkey").alias("offset"), F.col("l_linenumber").alias("length"))
    volumes = t("supplier").select(F.col("s_suppkey").alias("volume_id"), (F.col("s_suppkey") * 20 + 4000).cast("long").alias("size"))
    out = payloads.volume_stats(needles, volumes)
    return out.withColumns({"live_bytes": F.col("live_bytes").cast("long"), "end": F.col("end").cast("long")})


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_returnflag")
def line_fit(t, spark):
    fit = folds.line_fit(t("lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return fit.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("SELECT event_type, round(sum(value * (event_id % 5 + 1)), 4) AS integral, max(value) AS peak, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS mean, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def usage_rollup(t, spark):
    got = folds.usage(t("events").withColumn("seconds", F.col("event_id") % 5 + 1), ["event_type"], "seconds", "value")
    return got.select("event_type", F.round("integral", 4).alias("integral"), "peak", F.round("mean", 6).alias("mean"), "n")


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 8) AS share FROM events WHERE value > 0")
def share_of_total(t, spark):
    return folds.share_of_total(t("events").where("value > 0"), "value", "user_id").select("event_id", F.round("share", 8).alias("share"))


@query("SELECT n // 500 AS batch, count(*)::BIGINT AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) GROUP BY ALL")
def count_batches(t, spark):
    return batches(t("events"), 500, "event_id").select("batch", F.size("items").cast("long").alias("n"), F.array_min("items").alias("first"), F.array_max("items").alias("last"))


# -- functions ---------------------------------------------------------------------


@query("""SELECT DISTINCT lang, source, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS _key FROM documents""")
def dedupe_content_key(t, spark):
    return keyed(t("documents").select("source", "lang"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ', ') AS tags FROM (SELECT p_partkey, list_filter(string_split(p_type || ' ' || p_name || ' ' || p_type, ' '), lambda x: x <> '') AS w FROM part)")
def tags_normalise(t, spark):
    words = F.concat_ws(" ", "p_type", "p_name", "p_type")
    return t("part").select("p_partkey", scalars.tags(F.regexp_replace(words, " ", " , ,")).alias("tags"))


@query("SELECT doc_id, lang, source FROM documents WHERE lower(source) LIKE '%1%' OR lower(lang) LIKE '%1%' OR lower(doc_id::VARCHAR) LIKE '%1%' ORDER BY source, doc_id LIMIT 40 OFFSET 40")
def project_search(t, spark):
    return registry.search(t("documents").select("doc_id", "lang", "source"), "1", ["source", "lang", "doc_id"], sort="source", page=1, key="doc_id")


# -- writes -------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def upsert_merge(t, spark):
    old = t("customer").select("c_custkey", "c_name", "c_nationkey")
    names = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), F.lit(None).cast(old.schema["c_nationkey"].dataType).alias("c_nationkey"), F.array(F.lit("c_name")).alias("has"), F.lit(1).alias("seq"))
    nations = old.where("c_custkey % 2 = 0").select("c_custkey", F.lit("unused").alias("c_name"), F.lit(None).cast(old.schema["c_nationkey"].dataType).alias("c_nationkey"), F.array(F.lit("c_nationkey")).alias("has"), F.lit(2).alias("seq"))
    return sinks.upsert(old, names.union(nations), ["c_custkey"])


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders) SELECT l_orderkey, l_linenumber, l_partkey, p.id AS order_id FROM lineitem JOIN p ON l_orderkey = o_orderkey")
def graph_fk(t, spark):
    orders = t("orders").select(F.col("o_orderkey").alias("element"), F.lit("o").alias("ref"), F.col("o_orderkey").alias("seq"))
    lines = t("lineitem").select(F.col("l_orderkey").alias("element"), F.lit(None).cast("string").alias("ref"), F.monotonically_increasing_id().alias("seq"), F.lit("o").alias("order_ref"), "l_orderkey", "l_linenumber", "l_partkey")
    made = sinks.write_graph({"orders": orders, "lines": lines}, [sinks.Relation("orders", "lines", "order_id", "order_ref")])
    return made["lines"].select("l_orderkey", "l_linenumber", "l_partkey", "order_id")


@query("SELECT o_orderkey AS sink_key, o_custkey AS commit_key FROM orders WHERE o_orderkey % 4 <> 0")
def commit_ledger(t, spark):
    batch = t("orders").select(F.col("o_orderkey").alias("sink_key"), F.col("o_custkey").alias("commit_key"))
    return sinks.not_committed(batch, batch.where("sink_key % 4 = 0"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'three' ELSE c_name END AS c_name FROM customer WHERE c_nationkey <> 5")
def update_delete(t, spark):
    c = sinks.delete(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_nationkey") == 5)
    return sinks.update_rows(c, {"c_name": "three"}, F.col("c_nationkey") == 3).select("c_custkey", "c_name")


# -- flow and recovery ----------------------------------------------------------------


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def resume_remaining(t, spark):
    work = t("events").select("event_id").withColumn("_key", F.col("event_id").cast("string"))
    ledger = work.where("event_id % 5 = 0 OR event_id % 7 = 0").select("_key", F.when(F.col("event_id") % 5 == 0, "done").otherwise("failed").alias("status"))
    return remaining(work, ledger).select("event_id")


@query("SELECT o_orderkey::VARCHAR AS _key, o_orderkey * 2 AS twice FROM orders WHERE o_orderkey % 10 <> 0")
def task_map(t, spark):
    def double(e: dict) -> dict:
        if e["k"] % 10 == 0:
            raise ValueError("multiple of ten")
        return {"twice": int(e["k"]) * 2}

    rows = t("orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderkey").alias("k"))
    return results(apply(rows, task(double), "twice bigint"))


@query("SELECT o_orderkey::VARCHAR AS _key, 'ValueError: multiple of ten' AS error FROM orders WHERE o_orderkey % 10 = 0")
def task_errors(t, spark):
    def check(items: list[dict]) -> list[dict]:
        if any(e["k"] % 10 == 0 for e in items):
            raise ValueError("multiple of ten")
        return [{"ok": True} for _ in items]

    rows = t("orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderkey").alias("k"))
    return apply(rows, task(check, batched=True), "ok boolean").where("error IS NOT NULL").select("_key", "error")


@query("SELECT o_orderkey::VARCHAR AS _key, 'half' AS node, o_orderkey // 2 AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'next', o_orderkey // 2 + 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'same', o_orderkey FROM orders")
def chain_nodes(t, spark):
    def half(e, previous):
        if e["k"] % 2:
            raise ValueError("odd")
        return {"v": int(e["k"]) // 2}

    steps = chain({"half": half, "next": lambda e, p: {"v": p["half"]["v"] + 1}, "same": lambda e, p: {"v": int(e["k"])}}, needs={"next": "half"})
    rows = t("orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderkey").alias("k"))
    return results(apply(rows, steps, "node string, v bigint"))


@query("WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 13 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.n_chars <> b.n_chars")
def manifest_diff(t, spark):
    docs = t("documents").select("doc_id", "n_chars")
    found = docs.where("doc_id % 11 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 9 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return folds.manifest_diff(docs.where("doc_id % 13 <> 0"), found, "doc_id", ["n_chars"])
