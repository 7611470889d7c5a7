"""Aggregates and set operations over jobs, nodes and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage(samples: DataFrame, by: Sequence[str], seconds: str, held: str, used: str | None = None) -> DataFrame:
    """Of each group: what was held times how long, the most held, and the mean of what was used, weighed by time."""
    used = used or held
    mean = F.sum(F.col(used) * F.col(seconds)) / F.sum(seconds)
    return samples.groupBy(*by).agg(F.sum(F.col(held) * F.col(seconds)).alias("integral"), F.max(held).alias("peak"), mean.alias("mean"), F.count("*").alias("n"))


def share_of_total(rows: DataFrame, value: str, by: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's total: partial sums and a join, so no task holds a group."""
    totals = rows.groupBy(F.col(by).alias("__by")).agg(F.sum(value).alias("__total"))
    return rows.join(totals, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col(value) / F.col("__total")).drop("__by", "__total")


def accounting(steps: DataFrame, job: str = "job") -> DataFrame:
    """Of a job's steps: the longest wall time, all CPU time, the most slots, the peak of memory."""
    return steps.groupBy(job).agg(F.max("wall").alias("wall"), F.sum("cpu").alias("cpu"), F.max("slots").alias("slots"), F.max("memory").alias("memory"))


def nodes(rows: DataFrame, node: str = "node", partition: str = "partition", slots: str = "slots") -> DataFrame:
    """Of each node its partitions in order, without the star of the default one, and its slots, counted once a partition's row."""
    return rows.groupBy(node).agg(F.array_sort(F.collect_set(F.rtrim(F.col(partition), F.lit("*")))).alias("partitions"), F.max(slots).alias("slots"))


def line_fit(rows: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def progress(ledger: DataFrame, job: str = "job") -> DataFrame:
    """Elements of each job by status, and the share that is done, failed or running."""
    n = {s: F.count_if(F.col("status") == s) for s in ("done", "failed", "running")}
    out = ledger.groupBy(job).agg(*[c.alias(s) for s, c in n.items()], F.count("*").alias("total"))
    return out.withColumn("progress", (F.col("done") + F.col("failed") + F.col("running")) / F.col("total"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The same n rows of a population each time: the least by a seeded hash (a top-k, not a sort)."""
    return rows.withColumn("__h", F.xxhash64(F.lit(seed), key)).orderBy("__h", key).limit(n).drop("__h")


def by_rank(rows: DataFrame, ranks: DataFrame, key: str, rank: str, then: Sequence[str]) -> DataFrame:
    """Rows in the order of an outer ranking, the unranked ones after it in their own."""
    named = ranks.select(F.col(key).alias("__key"), F.col(rank).alias("__rank"))
    return rows.join(named, F.col(key) == F.col("__key"), "left").orderBy(F.col("__rank").asc_nulls_last(), *then).drop("__key", "__rank")


def newest_attempt(rows: DataFrame, name: str = "name") -> DataFrame:
    """Of names ``<stem>-<number>`` the one of the largest number for each stem: ``stem``, ``attempt``, ``name``."""
    cut = rows.select(F.col(name).alias("name"), F.regexp_extract(name, r"^(.*)-(\d+)$", 1).alias("stem"), F.regexp_extract(name, r"^(.*)-(\d+)$", 2).try_cast("long").alias("attempt"))
    return cut.where(F.col("attempt").isNotNull()).groupBy("stem").agg(F.max("attempt").alias("attempt"), F.max_by("name", "attempt").alias("name"))


def has_all(names: Column, wanted: Sequence[str]) -> Column:
    """Whether an array holds every wanted name."""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), F.coalesce(names, F.array().cast("array<string>")))) == 0


def live_over_recorded(live: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the live one's values, and the recorded ones where it has null."""
    cols = [c for c in recorded.columns if c != key]
    a = live.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cols])
    both = recorded.join(a, F.col(key) == F.col("__k"), "full_outer")
    return both.select(F.coalesce("__k", key).alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in cols])


def manifest_diff(manifest: DataFrame, found: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``key``, ``state``: missing (listed, not found), changed (found with other values) or extra (found, not listed)."""
    other = found.select(F.col(key).alias("__k"), *[F.col(v).alias(f"__{v}") for v in values])
    both = manifest.join(other, F.col(key) == F.col("__k"), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    state = F.when(F.col("__k").isNull(), "missing").when(F.col(key).isNull(), "extra").when(~same, "changed")
    return both.withColumn("state", state).where(F.col("state").isNotNull()).select(F.coalesce(key, "__k").alias(key), "state")


def without(have: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one side that the other doesn't have."""
    return have.select(key).distinct().join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_anti")


def union_nodes(tables: dict[str, DataFrame], name: str = "node") -> DataFrame:
    """Rows of all tables under the union of their columns, each with its table's name."""
    out: DataFrame | None = None
    for n, df in tables.items():
        part = df.withColumn(name, F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def before(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, name: str) -> DataFrame:
    """The sizes of a group's earlier rows, summed."""
    earlier = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(earlier), F.lit(0)))


def fold(rows: DataFrame, zero: Callable[[], object], add: Callable[[object, dict], object], merge: Callable[[object, object], object], width: int = 32) -> object:
    """A Python fold of all rows: each task folds its rows, folds are merged ``width`` at a time, the last on the driver.

    ``zero`` makes an empty fold, ``add`` puts in a row, ``merge`` joins two folds;
    their order isn't fixed.  What is merged is a fold, never rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = zero()
        for batch in batches:
            for row in batch.to_pylist():
                got = add(got, row)
        yield pa.RecordBatch.from_pydict({"v": pa.array([cloudpickle.dumps(got)], pa.binary())})

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = zero()
        for batch in batches:
            for v in batch.column(0).to_pylist():
                got = merge(got, cloudpickle.loads(v))
        yield pa.RecordBatch.from_pydict({"v": pa.array([cloudpickle.dumps(got)], pa.binary())})

    parts = rows.mapInArrow(each, "v binary")
    parts = parts.withColumn("__p", F.pmod(F.xxhash64("v"), F.lit(width))).repartition(width, "__p").select("v").mapInArrow(some, "v binary")
    out = zero()
    for r in parts.collect():  # at most ``width`` folds
        out = merge(out, cloudpickle.loads(bytes(r["v"])))
    return out
