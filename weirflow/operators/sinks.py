"""Writes as rewrites: partial upsert, updates, generated keys for related tables, and the commit ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.sources.reads import numbered


def with_defaults(df: DataFrame, defaults: Mapping[str, object], has: str = "has") -> DataFrame:
    """Columns that a row doesn't carry (``has``: array of those it does) get their default; an explicit null stays."""
    return df.withColumns({c: F.when(F.array_contains(has, c), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()})


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], has: str = "has", seq: str = "seq") -> DataFrame:
    """``table`` after rows that carry only some columns (named in ``has``), in the order of ``seq``.

    For each key and column the last present value wins; a column that no row carries keeps its old value.
    """
    if not rows.where(" OR ".join(f"{k} IS NULL" for k in keys)).isEmpty():
        raise ValueError("a row lacks a key")
    cols = [c for c in table.columns if c not in keys]
    aggs: list[Column] = []
    for c in cols:
        carried = F.array_contains(has, c)
        aggs += [F.max(carried).alias(f"__has_{c}"), F.max_by(F.struct(F.col(c)), F.when(carried, F.col(seq))).alias(f"__new_{c}")]
    last = rows.groupBy(*keys).agg(*aggs)
    both = table.withColumn("__old", F.lit(True)).join(last, list(keys), "full_outer")
    made = [F.when(F.col(f"__has_{c}"), F.col(f"__new_{c}")[c]).otherwise(F.col(c)).alias(c) for c in cols]
    return both.select(*keys, *made).select(*table.columns)


def update_rows(table: DataFrame, values: Mapping[str, object], where: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


@dataclass(frozen=True)
class Relation:
    """``child.fk`` gets the id of the ``parent`` row whose ``ref`` equals the child's ``$ref`` column."""

    parent: str
    child: str
    fk: str
    ref_column: str
    deferred: bool = False


def topological(nodes: Sequence[str], relations: Sequence[Relation]) -> list[str]:
    """Parents first, ties by name; deferred relations don't count; a cycle is an error."""
    needs = {n: {r.parent for r in relations if r.child == n and not r.deferred} for n in nodes}
    out: list[str] = []
    while needs:
        ready = sorted(n for n, p in needs.items() if p <= set(out))
        if not ready:
            raise ValueError(f"cycle among {sorted(needs)}")
        out.append(ready[0])
        del needs[ready[0]]
    return out


def write_graph(nodes: Mapping[str, DataFrame], relations: Sequence[Relation], first_id: Mapping[str, int] | None = None, element: str = "element", ref: str = "ref", order: str = "seq") -> dict[str, DataFrame]:
    """Tables with generated ``id`` columns and resolved foreign keys.

    A ref holds within its element.  An explicit foreign key wins; a null ref is
    skipped; an unknown one is an error before anything is written; so is a
    duplicate ref that a relation resolves.  ``order`` is a unique integer.
    """
    made: dict[str, DataFrame] = {}
    for name in topological(list(nodes), relations):
        df = numbered(nodes[name], order, "id")
        made[name] = df.withColumn("id", F.col("id") + (first_id or {}).get(name, 1))
    for r in sorted(relations, key=lambda r: r.deferred):
        names = made[r.parent].where(F.col(ref).isNotNull()).select(F.col(element).alias("__e"), F.col(ref).alias("__r"), F.col("id").alias("__id"))
        child = made[r.child]
        own = F.col(r.fk).isNotNull() if r.fk in child.columns else F.lit(False)
        asked = child.where(F.col(r.ref_column).isNotNull() & ~own)
        on = (F.col(element) == F.col("__e")) & (F.col(r.ref_column) == F.col("__r"))
        if not asked.join(names, on, "left_anti").isEmpty():
            raise ValueError(f"{r.child}.{r.ref_column} names an unknown ref of {r.parent}")
        twice = names.groupBy("__e", "__r").count().where("count > 1")
        if not asked.join(twice, on, "left_semi").isEmpty():
            raise ValueError(f"a ref of {r.parent} is given twice")
        old = F.col(r.fk) if r.fk in child.columns else F.lit(None).cast("long")
        made[r.child] = child.join(names, on, "left").withColumn(r.fk, F.coalesce(old, F.col("__id"))).drop("__e", "__r", "__id")
    return made


def not_committed(batch: DataFrame, ledger: DataFrame, sink: str = "sink_key", commit: str = "commit_key") -> DataFrame:
    """Rows whose (sink, commit) isn't in the ledger yet."""
    return batch.join(ledger.select(sink, commit).distinct(), [sink, commit], "left_anti")


def receipts(batch: DataFrame, table_name: str, sink: str = "sink_key", commit: str = "commit_key") -> DataFrame:
    return batch.groupBy(sink, commit).agg(F.lit(table_name).alias("table_name"), F.count("*").alias("row_count"))


def write_files(df: DataFrame, path: str, fmt: str = "json", append: bool = False, per_batch: bool = False) -> None:
    """A directory of text or JSON part files."""
    if append and (fmt == "json" or per_batch):
        raise ValueError("append goes with neither json nor per_batch")
    out = df.write.mode("append" if append or per_batch else "overwrite")
    out.json(path) if fmt == "json" else out.text(path)


def latest(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The row of the largest ``order`` for each key: a partial aggregate, then one small shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*").select(*df.columns)


def prefix_offsets(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("part_offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
