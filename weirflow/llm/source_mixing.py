"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its target share of the total over its own
share.  Every document gets a number of copies from a Poisson distribution with
that mean, found by inverting it at a uniform number hashed from the seed and
the document's id; so a rerun of a lost task gives the same copies.  Copies are
exploded and dealt to partitions by a hash, in hash order within each: a global
shuffle without a hot key.

Defined results: a null source is a source of its own; a null text has size 0; a
source of size 0 has rate 1; rows of the same id get the same number of copies;
a null id hashes as an empty one; an empty table gives an empty result; an input
column named ``copy`` is replaced.  Rows that draw zero copies go: that is the
operator's purpose.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import read_table

#: Target shares grow as this power of a source's size, unless weights are given.
POWER = 0.7
SEED = 17
#: A larger mean is drawn as a sum of independent Poisson numbers of at most this mean.
LARGEST_MEAN = 8.0
#: Beyond it the distribution's tail at LARGEST_MEAN is under 1e-15.
TERMS = 48
#: Up to so many sources their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, source: str = "source", text: str = "text") -> DataFrame:
    """``source``, ``rate``: mean copies of each document; ``weights`` missing for a source count as 0."""
    size = F.coalesce(F.sum(F.char_length(F.col(f"`{text}`"))), F.lit(0)).cast("double").alias("size")
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(size)
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow("size", F.lit(power))).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    if not total["size"] or not total["weight"]:
        return sizes.select("source", F.lit(1.0).alias("rate"))
    rate = F.round(F.col("weight") / F.lit(total["weight"]) * F.lit(total["size"]) / F.col("size"), 9)
    return sizes.select("source", F.when(F.col("size") > 0, rate).otherwise(1.0).alias("rate"))


def inversion(rate: Column) -> Column:
    """Draws that add up to the mean, and the distribution function of each at 0, 1, 2, ..."""
    draws = F.greatest(F.ceil(rate / LARGEST_MEAN), F.lit(1))
    mean = rate / draws
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), F.array(zero).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["cdf"])
    return F.struct(draws.cast("int").alias("draws"), cdf.alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, seed: int = SEED, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as it was drawn (``copy`` from 1), shuffled globally."""
    table = rates(docs, weights, power, source, text).select(F.col("source").alias("__source"), inversion(F.col("rate")).alias("__inv"))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = docs.drop("copy").join(table, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    cdf = F.col("__inv.cdf")

    def drawn(j: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, j.cast("string"))
        return F.aggregate(cdf, F.struct(u.alias("u"), F.lit(0).alias("n")), lambda a, c: F.struct(a["u"].alias("u"), (a["n"] + (c <= a["u"]).cast("int")).alias("n")), lambda a: a["n"])

    copies = F.aggregate(F.sequence(F.lit(1), F.col("__inv.draws")), F.lit(0), lambda n, j: n + drawn(j))
    rows = rows.withColumn("__n", copies).where(F.col("__n") > 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long")))).drop("__n", "__inv", "__source")
    order = F.xxhash64(F.lit(seed), key, F.col("copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("__order", order).repartition(parts, "__order").sortWithinPartitions("__order").drop("__order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH s AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source
), t AS (
  SELECT *, CASE WHEN size > 0 THEN power(size, 0.7) ELSE 0 END AS weight FROM s
), r AS (
  SELECT source, CASE WHEN size > 0 THEN round(weight / sum(weight) OVER () * sum(size) OVER () / size, 9) ELSE 1.0 END AS rate FROM t
), m AS (
  SELECT source, greatest(ceil(rate / 8.0), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM r
), p AS (
  SELECT source, draws, k, sum(exp(-mean + CASE WHEN k = 0 THEN 0 ELSE k * ln(mean) END - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM m, range(0, 49) x(k)
), u AS (
  SELECT d.doc_id, d.source, j, ('0x' || md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j)[1:13])::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, range(1, 1000) y(j) WHERE j <= draws
), n AS (
  SELECT u.doc_id, u.source, count(*) AS n FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cdf <= u.u GROUP BY ALL
)
SELECT doc_id, source, unnest(range(1, n + 1))::BIGINT AS copy FROM n
"""
