"""Tables that are written: versioned Parquet directories and the sinks that write them.

A table's folder holds one folder a version; the newest complete one is what
readers see.  Appending adds files to it under Spark's commit protocol; an upsert,
update or delete writes the next version and so swaps it in at once.  A reader that
has begun keeps the version it began with, until ``vacuum`` drops it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.operators import sinks
from weirflow.plans.compiler import Codec


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/weirflow-{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Table:
    """A table of fixed columns.

    ``keys`` name its rows for upserts; ``computed`` columns are made on reading and
    never written; ``codecs`` store coded columns; ``defaults`` fill columns that the
    rows to write don't have; ``checks`` are conditions that every written row meets.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = (), computed: Mapping[str, Column] = {}, codecs: Mapping[str, tuple[Callable[[Column], Column], Codec]] = {}, defaults: Mapping[str, object] = {}, checks: Mapping[str, Column] = {}
    ):
        self.spark, self.path, self.schema = spark, path, StructType.fromDDL(schema)
        self.keys, self.computed, self.codecs, self.defaults, self.checks = tuple(keys), dict(computed), dict(codecs), dict(defaults), dict(checks)

    def versions(self) -> list[int]:
        fs, p = _files(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(_files(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in done)

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:08d}"

    def stored(self, version: int | None = None) -> DataFrame:
        """Columns as they are written."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(have[-1] if version is None else version))

    def read(self, version: int | None = None) -> DataFrame:
        df = self.stored(version)
        return df.withColumns({c: codec.decode(F.col(c)) for c, (_, codec) in self.codecs.items()} | self.computed)

    def bound(self, rows: DataFrame) -> DataFrame:
        """``rows`` as they are written: without computed columns, coded, in the columns' types, checked."""
        unknown = set(rows.columns) - set(self.schema.names) - set(self.computed)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        have = set(rows.columns)
        for name, check in self.checks.items():
            if not rows.where(~F.coalesce(check, F.lit(False))).isEmpty():
                raise ValueError(f"rows that don't meet {name}")
        coded = {c: encode(F.col(c)) for c, (encode, _) in self.codecs.items() if c in have}
        rows = rows.withColumns(coded)
        made = [(F.col(f.name) if f.name in have else F.lit(self.defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return rows.select(*made)

    def _swap(self, df: DataFrame) -> None:
        have = self.versions()
        df.write.parquet(self._folder(have[-1] + 1 if have else 1))

    def insert(self, rows: DataFrame) -> None:
        """Appends; nothing is seen of a write that fails."""
        have = self.versions()
        self.bound(rows).write.mode("append").parquet(self._folder(have[-1] if have else 1))

    def upsert(self, rows: DataFrame, keys: Sequence[str] = (), seq: str | None = None) -> None:
        """Rows with the keys of a stored one replace the columns they carry; of several the last by ``seq`` wins."""
        keys = tuple(keys) or self.keys
        if not keys:
            raise ValueError("an upsert needs keys")
        order = rows.select(*[c for c in rows.columns if c != seq])
        new = self.bound(order).withColumns({"has": F.array(*[F.lit(c) for c in order.columns]), "seq": F.lit(0)})
        if seq:
            new = self.bound(sinks.latest(rows, list(keys), seq).drop(seq)).withColumns({"has": F.array(*[F.lit(c) for c in order.columns]), "seq": F.lit(0)})
        self._swap(sinks.upsert(self.stored(), new, list(keys)))

    def update(self, values: Mapping[str, object], where: Column, limit: int | None = None, order: str | None = None) -> int:
        """Sets columns of the rows found, of the first ``limit`` by ``order`` if given; how many there were."""
        old = self.stored()
        if limit is not None:
            key = order or self.keys[0]
            last = old.where(where).orderBy(key).limit(limit).agg(F.max(key)).first()[0]
            where = where & (F.col(key) <= F.lit(last))
        count = old.where(where).count()
        if count:
            self._swap(sinks.update_rows(old, values, where).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]))
        return count

    def delete(self, where: Column) -> int:
        old = self.stored()
        count = old.where(where).count()
        if count:
            self._swap(sinks.delete(old, where))
        return count

    def vacuum(self, keep: int = 1) -> list[int]:
        """Drops all but the newest versions."""
        gone = self.versions()[: -max(keep, 1)]
        for v in gone:
            fs, p = _files(self.spark, self._folder(v))
            fs.delete(p, True)
        return gone


@dataclass(frozen=True)
class TableSink:
    """Where rows go: a table, how, and under which commit key they are written at most once."""

    table: Table
    write_mode: str = "bulk"
    columns: tuple[str, ...] = ()
    conflict_keys: tuple[str, ...] = ()
    ledger: Table | None = None
    name: str = "sink"

    def __post_init__(self) -> None:
        if self.write_mode not in ("bulk", "row", "upsert"):
            raise ValueError(f"unknown write mode: {self.write_mode}")
        if self.write_mode == "upsert" and not (self.conflict_keys or self.table.keys):
            raise ValueError("an upsert needs conflict keys")

    def write(self, rows: DataFrame, commit: str | None = None) -> bool:
        """False if the ledger says that this commit is written already."""
        if commit is not None and self.ledger is not None:
            if not self.ledger.stored().where((F.col("sink_key") == self.name) & (F.col("commit_key") == commit)).isEmpty():
                return False
        rows = rows.select(*self.columns) if self.columns else rows
        if self.write_mode == "upsert":
            self.table.upsert(rows, self.conflict_keys)
        else:
            self.table.insert(rows)
        if commit is not None and self.ledger is not None:
            self.ledger.insert(rows.agg(F.lit(self.name).alias("sink_key"), F.lit(commit).alias("commit_key"), F.count("*").alias("row_count")))
        return True


@dataclass(frozen=True)
class FileSink:
    """Text or JSON files: whole, appended, or numbered by batch."""

    path: str
    fmt: str = "json"
    append: bool = False
    per_batch: bool = False
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.append and (self.fmt == "json" or self.per_batch):
            raise ValueError("append goes with neither json nor per_batch")

    def write(self, rows: DataFrame, batch: int | None = None) -> str:
        """The folder written; a batch's own is ``<path>_00001`` and so on, so a repeated batch replaces itself."""
        path = f"{self.path}_{batch:05d}" if self.per_batch and batch is not None else self.path
        out = rows.write.mode("append" if self.append else "overwrite").options(**self.extra)
        out.json(path) if self.fmt == "json" else out.text(path)
        return path


def persist(rows: DataFrame, sink: TableSink | FileSink | Callable[[DataFrame], object]) -> object:
    """Writes rows to any sink: a table, files, or a function of the rows."""
    return sink.write(rows) if isinstance(sink, (TableSink, FileSink)) else sink(rows)


def deliver(rows: DataFrame, write: Callable[[DataFrame], object], key: str, groups: int = 256, on_error: Callable[[list, Exception], None] | None = None) -> int:
    """Writes rows in groups of keys; a group that fails is halved down to single keys, which are reported.

    Returns how many keys failed.  For sinks outside of Spark: one write a group, not a row.
    """
    work = rows.withColumn("__g", F.pmod(F.xxhash64(key), F.lit(groups)))
    failed, todo = 0, [(groups, g) for g in range(groups)] if groups > 1 else [(1, 0)]
    while todo:
        parts, g = todo.pop()
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == g) if parts != groups else work.where(F.col("__g") == g).drop("__g")
        try:
            if not part.isEmpty():
                write(part)
        except Exception as e:
            keys = [r[0] for r in part.select(key).distinct().limit(2).collect()]
            if len(keys) < 2:
                failed += 1
                if on_error:
                    on_error(keys, e)
            else:
                todo += [(parts * 2, g), (parts * 2, g + parts)]
    return failed
