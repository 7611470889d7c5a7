"""Reads over compiled specs: rows, streams, counts, keyset pages, bounded scans, selections, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.plans.compiler import Tables, compile_spec
from weirflow.spec import QuerySpec, order_terms


class NoResultFound(LookupError):
    pass


class MultipleResultsFound(LookupError):
    pass


def rows(spark: SparkSession, tables: Tables, spec: QuerySpec) -> list[dict]:
    return [r.asDict() for r in compile_spec(spec, tables, spark).collect()]


def stream(spark: SparkSession, tables: Tables, spec: QuerySpec) -> Iterator[dict]:
    """Rows one partition at a time; the driver never holds more than two."""
    return (r.asDict() for r in compile_spec(spec, tables, spark).toLocalIterator(prefetchPartitions=True))


def count(spark: SparkSession, tables: Tables, spec: QuerySpec) -> int:
    return compile_spec(replace(spec, order=()) if spec.limit is None and not spec.offset else spec, tables, spark).count()


def page_after(df: DataFrame, key: str, after: Any, limit: int, ascending: bool = True) -> DataFrame:
    """The next ``limit`` rows beyond ``after`` in key order (a top-k, not a sort)."""
    if after is not None:
        df = df.where(F.col(key) > F.lit(after) if ascending else F.col(key) < F.lit(after))
    return df.orderBy(F.col(key).asc() if ascending else F.col(key).desc()).limit(limit)


def pages(df: DataFrame, key: str = "id", page_size: int = 500) -> Iterator[list[dict]]:
    """Keyset pages; a key that comes twice at a page's edge, where rows would be lost, is an error.

    Without the key among the columns, rows come as a plain stream, cut to pages.
    """
    if key not in df.columns:
        page: list[dict] = []
        for r in df.toLocalIterator():
            page.append(r.asDict())
            if len(page) == page_size:
                yield page
                page = []
        if page:
            yield page
        return
    after = None
    while got := page_after(df, key, after, page_size + 1).collect():
        if len(got) > page_size and got[-1][key] == got[-2][key]:
            raise ValueError(f"{key} isn't unique")
        got = got[:page_size]
        after = got[-1][key]
        yield [r.asDict() for r in got]


def page_with_cursor(df: DataFrame, cursor: str, after: Any, limit: int, ascending: bool = True, fields: tuple[str, ...] = ()) -> tuple[list[dict], Any]:
    """The page after a cursor and the next cursor, None at the end; the cursor's column is left out unless asked for."""
    got = [r.asDict() for r in page_after(df.select(*dict.fromkeys([*(fields or df.columns), cursor])), cursor, after, limit, ascending).collect()]
    following = got[-1][cursor] if len(got) == limit else None
    return [{k: v for k, v in r.items() if not fields or k in fields} for r in got], following


class Rows:
    """A whole table in key order, bounded by the largest key at the first read.

    ``state`` carries the bound and the last key; rows that arrive later never enter.
    """

    def __init__(self, df: DataFrame, spec: QuerySpec, key: str, state: dict | None = None):
        if spec.query or spec.limit is not None or spec.offset or any(c != key for c, _ in order_terms(spec.order)):
            raise ValueError("a bounded scan takes a table with filters only")
        self.df, self.key = df, key
        self.state = state if state is not None else {}

    def frame(self) -> DataFrame:
        if "cap" not in self.state:
            self.state["cap"] = self.df.agg(F.max(self.key)).first()[0]
        out = self.df.where(F.col(self.key) <= F.lit(self.state["cap"]))
        return out.where(F.col(self.key) > F.lit(self.state["after"])) if "after" in self.state else out

    def remaining(self) -> int:
        return self.frame().count()

    def __iter__(self) -> Iterator[dict]:
        for r in self.frame().orderBy(self.key).toLocalIterator():
            self.state["after"] = r[self.key]
            yield r.asDict()


class Selection:
    """A lazy collection that may be read again and again."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.df.toLocalIterator())

    def count(self) -> int:
        return self.df.count()

    def first(self) -> dict | None:
        got = self.df.take(1)
        return got[0].asDict() if got else None

    def one_or_none(self) -> dict | None:
        got = self.df.take(2)
        if len(got) > 1:
            raise MultipleResultsFound
        return got[0].asDict() if got else None

    def one(self) -> dict:
        got = self.one_or_none()
        if got is None:
            raise NoResultFound
        return got


def numbered(df: DataFrame, order: str, name: str = "n", parts: int = 0) -> DataFrame:
    """Rows numbered from 0 in the order of a unique key, without one task that sees them all.

    Range partitions of like sizes, whatever the keys' gaps; one row a partition is
    counted and summed, and numbers within a partition follow on the ones before.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts).alias("b")).first()["b"] if parts > 1 else []
    at = F.lit(0)
    for b in sorted(set(bounds or [])):
        at = at + (F.col(order) > F.lit(b)).cast("int")
    rows_ = df.withColumn("__b", at)
    sizes = rows_.groupBy("__b").count()
    offsets = sizes.select("__b", F.coalesce(F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    rows_ = rows_.withColumn("__k", F.row_number().over(W.partitionBy("__b").orderBy(order)) - 1).join(F.broadcast(offsets), "__b")  # at most ``parts`` rows
    return rows_.withColumn(name, F.col("__o") + F.col("__k")).drop("__b", "__k", "__o")


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """``batch`` and its rows' keys: consecutive runs of ``size`` rows."""
    n = numbered(df, order).withColumn("batch", F.floor(F.col("n") / size))
    return n.groupBy("batch").agg(F.sort_array(F.collect_list(order)).alias("items"))


def inline(spark: SparkSession, items: Iterable[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(x.values()) for x in items], schema)


def files(spark: SparkSession, path: str, fmt: str = "text", content: bool = True) -> DataFrame:
    """Whole files as binary, text or JSON; or just their paths."""
    if not content:
        return spark.read.format("binaryFile").load(path).select("path")
    if fmt == "binary":
        return spark.read.format("binaryFile").load(path)
    if fmt == "text":
        return spark.read.text(path, wholetext=True)
    if fmt == "json":
        return spark.read.json(path, multiLine=True)
    raise ValueError(f"unknown format: {fmt}")


def where_python(df: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """An opaque predicate over rows as dicts; nulls are None and longs stay exact."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(predicate(r)) for r in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(keep, df.schema)
