"""Compiles a QuerySpec to a DataFrame; Catalyst does the rest.

All filters are ANDed.  Two dialects differ in corner cases: in "spec" mode
``eq``/``ne`` with None match nothing and a text pattern of None searches the
word None; in "model" mode None means IS (NOT) NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.spec import QuerySpec, identifier, order_terms

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Codec:
    """How a coded column is stored: ``encode`` for literals of eq, ne, in and not_in, ``decode`` for output."""

    encode: Callable[[Any], Any]
    decode: Callable[[Column], Column]


def catalog(spark: SparkSession) -> Tables:
    return spark.table


def parquet_dir(spark: SparkSession, top: str) -> Tables:
    return lambda name: spark.read.parquet(f"{top}/{identifier(name)}.parquet")


def _typed(col: Column, kind: str, value: Any) -> Column:
    """The literal in the column's type; one that doesn't fit compares with nothing instead of failing."""
    if value is None or kind.startswith(("struct", "array", "map")):
        return F.lit(value)
    if isinstance(value, str) and kind != "string":
        return F.lit(value).try_cast(kind)
    if not isinstance(value, str) and kind == "string":
        return F.lit(str(value))
    return F.lit(value)


def _pattern(value: Any, before: str, after: str) -> str:
    """Wildcards in the value stay wildcards; a backslash is itself."""
    return before + str(value).replace("\\", "\\\\") + after


def json_path(col: Column, keys: list[str], value: Any) -> Column:
    """A JSON value that has the literal's own type; texts don't match numbers, nor numbers texts."""
    path = "$." + ".".join(keys)
    v = F.try_parse_json(col)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    if isinstance(value, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
    if isinstance(value, int):
        return F.when(kind.isin("BIGINT", "BOOLEAN") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "bigint"))
    if isinstance(value, float):
        return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _values(value: Any) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def condition(df: DataFrame, key: str, value: Any, codecs: Mapping[str, Codec], mode: str) -> Column | None:
    """The Boolean column of one filter; None for one that lets everything through."""
    name, _, op = key.partition("__")
    op = op or "eq"
    head, *path = name.split("->")
    identifier(head)
    col, kind = F.col(head), dict(df.dtypes).get(head.split(".")[-1], "string")
    codec = codecs.get(head)
    if codec and op in ("eq", "ne", "in", "not_in"):
        value = [codec.encode(x) for x in _values(value)] if op.endswith("in") else codec.encode(value)
    if path:
        first = next(iter(_values(value)), None)
        col, kind = json_path(col, [identifier(p) for p in path], first), "variant"
    typed = (lambda x: F.lit(x)) if path else (lambda x: _typed(col, kind, x))
    if op in ("eq", "ne") and value is None:
        if mode == "model":
            return col.isNull() if op == "eq" else col.isNotNull()
        return F.lit(False)
    compare = {"eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    if op in compare:
        return compare[op](col, typed(value))
    if op in ("contains", "startswith", "endswith"):
        before, after = {"contains": ("%", "%"), "startswith": ("", "%"), "endswith": ("%", "")}[op]
        return col.cast("string").ilike(_pattern(value, before, after))
    if op == "in":
        return col.isin(*[typed(x) for x in _values(value)]) if _values(value) else F.lit(False)
    if op == "not_in":
        return ~col.isin(*[typed(x) for x in _values(value)]) if _values(value) else None
    if op in ("is_null", "is_not_null"):
        null = (op == "is_null") == (value is None or bool(value))
        return col.isNull() if null else col.isNotNull()
    raise ValueError(f"unknown filter: {key}")


def _membership(df: DataFrame, name: str, sub: DataFrame, keep: bool) -> DataFrame:
    """IN as a semi join; NOT IN over the non-null values as an anti join that also drops null keys, unless there are no values."""
    values = sub.select(F.col(sub.columns[0]).alias("__value")).where(F.col("__value").isNotNull())
    if keep:
        return df.join(values, F.col(name) == F.col("__value"), "left_semi")
    out = df.join(values, F.col(name) == F.col("__value"), "left_anti")
    some = values.limit(1).agg(F.count("*").alias("__some"))  # one row: null keys stay only if there is no value
    return out.join(F.broadcast(some), F.col(name).isNotNull() | (F.col("__some") == 0), "inner").drop("__some")


def filtered(df: DataFrame, filters: Mapping[str, Any], tables: Tables, codecs: Mapping[str, Codec] = {}, mode: str = "spec") -> DataFrame:
    plain, joins = [], []
    for key, value in filters.items():
        name, _, op = key.partition("__")
        if op in ("in_subquery", "not_in_subquery"):
            for sub in value if isinstance(value, (list, tuple)) else [value]:
                if len(sub.fields) != 1:
                    raise ValueError("a subquery needs exactly one field")
                joins.append((identifier(name), sub, op == "in_subquery"))
        else:
            plain.append(condition(df, key, value, codecs, mode))
    for c in plain:
        df = df if c is None else df.where(c)
    for name, sub, keep in joins:
        df = _membership(df, name, compile_spec(sub, tables, df.sparkSession, codecs, mode, decode=False), keep)
    return df


def compile_spec(spec: QuerySpec, tables: Tables, spark: SparkSession, codecs: Mapping[str, Codec] = {}, mode: str = "spec", decode: bool = True) -> DataFrame:
    """The DataFrame of a spec; a raw query goes to SQL as it is.  A subquery's values stay as they are stored."""
    if spec.query is not None:
        return spark.sql(spec.query, args=list(spec.params)) if spec.params else spark.sql(spec.query)
    df = filtered(tables(spec.table), spec.filters, tables, codecs, mode)
    terms = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order_terms(spec.order)]
    df = df.orderBy(*terms) if terms else df
    df = df.offset(spec.offset) if spec.offset else df
    df = df.limit(spec.limit) if spec.limit is not None else df
    df = df.select(*spec.fields) if spec.fields else df
    return df.withColumns({c: k.decode(F.col(c)) for c, k in codecs.items() if c in df.columns}) if decode else df
