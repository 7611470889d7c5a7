"""Inputs and outputs named by values: tables, queries, items, bytes, files; as JSON for another process."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.plans.compiler import Tables, compile_spec
from weirflow.sources.reads import files
from weirflow.spec import QuerySpec


@dataclass(frozen=True)
class DbInput:
    """A read from the database of a role (a catalog's schema); ``columns`` and ``where`` are other names of ``fields`` and ``filters``."""

    table: str | None = None
    query: str | None = None
    fields: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    where: Mapping[str, Any] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    limit: int | None = None
    offset: int | None = None
    params: tuple = ()
    db_role: str = "project"
    db_path: str | None = None

    def __post_init__(self) -> None:
        if self.fields and self.columns and tuple(self.fields) != tuple(self.columns):
            raise ValueError("fields and columns differ")
        if self.filters and self.where and dict(self.filters) != dict(self.where):
            raise ValueError("filters and where differ")
        if self.db_role not in ("project", "executor", "custom"):
            raise ValueError(f"unknown role: {self.db_role}")
        if (self.db_role == "custom") != (self.db_path is not None):
            raise ValueError("a path goes with the role custom, and only with it")

    def spec(self) -> QuerySpec:
        return QuerySpec(self.table, tuple(self.fields or self.columns), dict(self.filters or self.where), self.order, self.limit, self.offset, self.query, self.params)

    def frame(self, spark: SparkSession, roles: Mapping[str, Tables]) -> DataFrame:
        if self.db_role == "custom":
            return compile_spec(self.spec(), lambda name: spark.read.parquet(f"{self.db_path}/{name}.parquet"), spark)
        return compile_spec(self.spec(), roles[self.db_role], spark)


@dataclass(frozen=True)
class Inline:
    """Items given as they are."""

    items: tuple
    schema: str

    def frame(self, spark: SparkSession, roles: Mapping[str, Tables] = {}) -> DataFrame:
        return spark.createDataFrame([tuple(x.values()) if isinstance(x, Mapping) else (x,) for x in self.items], self.schema)


@dataclass(frozen=True)
class Bytes:
    """Bytes given as they are; base64 on the wire."""

    data: bytes

    def frame(self, spark: SparkSession, roles: Mapping[str, Tables] = {}) -> DataFrame:
        return spark.createDataFrame([(bytearray(self.data),)], "content binary")


@dataclass(frozen=True)
class FileInput:
    """Files of a root (project, executor or absolute)."""

    path: str
    fmt: str = "text"
    root: str = "project"
    content: bool = True

    def frame(self, spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
        return files(spark, resolved(self.path, self.root, roots), self.fmt, self.content)


def resolved(path: str, root: str, roots: Mapping[str, str]) -> str:
    """The path under its root; one that leaves the root is an error."""
    if root == "absolute":
        if not os.path.isabs(path) and "://" not in path:
            raise ValueError(f"not an absolute path: {path}")
        return path
    out = os.path.normpath(path)
    if os.path.isabs(out) or out == ".." or out.startswith("../"):
        raise ValueError(f"{path} leaves its root")
    return f"{roots[root].rstrip('/')}/{out}"


def project_table(table: str, **more) -> DbInput:
    return DbInput(table=table, **more)


def project_query(query: str, *params) -> DbInput:
    return DbInput(query=query, params=params)


def project_file(path: str, fmt: str = "text") -> FileInput:
    return FileInput(path, fmt)


def inline_items(items: Iterable, schema: str) -> Inline:
    return Inline(tuple(items), schema)


def simple_items(items: Iterable, batch: int = 1) -> Iterator:
    """The items themselves, or lists of ``batch`` of them."""
    if batch <= 1:
        yield from items
        return
    group: list = []
    for x in items:
        group.append(x)
        if len(group) == batch:
            yield group
            group = []
    if group:
        yield group


class Source:
    """Any iterable, or a function of the state that opens one, read in chunks; the state says how many items were taken."""

    def __init__(self, items: Iterable | Callable[[dict], Iterable], schema: str, state: dict | None = None, chunk: int = 10_000):
        self.items, self.schema, self.state, self.chunk = items, schema, state if state is not None else {"taken": 0}, chunk

    def total(self) -> int | None:
        return len(self.items) if hasattr(self.items, "__len__") else None

    def remaining(self) -> int | None:
        return None if self.total() is None else self.total() - self.state["taken"]

    def frames(self, spark: SparkSession) -> Iterator[DataFrame]:
        """A DataFrame a chunk; the state moves on when the next one is asked for, so one that failed comes again."""
        opened = self.items(self.state) if callable(self.items) else iter(self.items)
        if not callable(self.items):
            for _ in range(self.state["taken"]):
                next(opened, None)
        for group in simple_items(opened, max(self.chunk, 2)):
            yield Inline(tuple(group), self.schema).frame(spark)
            self.state["taken"] += len(group)


_KINDS = {"db": DbInput, "inline": Inline, "bytes": Bytes, "file": FileInput, "query": QuerySpec}


def to_wire(value: Any) -> Any:
    """A value of dicts, lists, bytes and inputs as plain JSON; tuples and bytes are marked."""
    for kind, cls in _KINDS.items():
        if isinstance(value, cls):
            return {"$input": kind, "value": to_wire(dict(vars(value)))}
    if isinstance(value, bytes):
        return {"$bytes": base64.b64encode(value).decode()}
    if isinstance(value, tuple):
        return {"$tuple": [to_wire(v) for v in value]}
    if isinstance(value, list):
        return [to_wire(v) for v in value]
    if isinstance(value, Mapping):
        return {str(k): to_wire(v) for k, v in value.items()}
    return value


def from_wire(value: Any) -> Any:
    if isinstance(value, list):
        return [from_wire(v) for v in value]
    if not isinstance(value, dict):
        return value
    if set(value) == {"$bytes"}:
        return base64.b64decode(value["$bytes"])
    if set(value) == {"$tuple"}:
        return tuple(from_wire(v) for v in value["$tuple"])
    if set(value) == {"$input", "value"}:
        return _KINDS[value["$input"]](**from_wire(value["value"]))
    return {k: from_wire(v) for k, v in value.items()}


def has_inputs(value: Any) -> bool:
    """Whether a value holds an input somewhere."""
    if isinstance(value, tuple(_KINDS.values())):
        return True
    parts = value.values() if isinstance(value, Mapping) else value if isinstance(value, (list, tuple)) else ()
    return any(has_inputs(v) for v in parts)


def recorded(journal: DataFrame, limit: int, key: str = "n") -> DataFrame:
    """The last ``limit`` entries, oldest first."""
    return journal.orderBy(F.desc(key)).limit(limit).orderBy(key)


def failed(journal: DataFrame, job: str, limit: int = 200, key: str = "key") -> DataFrame:
    return journal.where((F.col("job") == job) & (F.col("status") == "failed")).orderBy(key).limit(limit)


def part_results(parts: DataFrame, index: str = "index") -> DataFrame:
    """Results of part files of JSON lines (``value``): lines cut short by a kill are left out, each index counts once, the latest attempt's."""
    rows = parts.select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    rows = rows.select(F.try_variant_get("v", f"$.{index}", "bigint").alias(index), F.coalesce(F.try_variant_get("v", "$.attempt", "bigint"), F.lit(0)).alias("attempt"), F.to_json("v").alias("value"))
    return rows.where(F.col(index).isNotNull()).groupBy(index).agg(F.max_by("value", F.struct("attempt", "value")).alias("value"))
