"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Up to so many rows of a few longs a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 400_000
#: A key of more than this part of all rows isn't joined by a shuffle.
HEAVY = 100_000

#: After so many tables of ``cut`` the driver's garbage is collected.
TABLES_A_COLLECTION = 8
_TABLES = count(1)

#: Paths of the tables cut within ``alone``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)

#: Parts of a group, level by level, from which a bounded sample is picked.
SALTS = (256, 16, 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, inside a single expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none of a null or blank one."""
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":  # five searches for a byte cost less than one regular expression
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no learner may look at: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def least_of_each(rows: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, the least by ``order``.

    Each level keeps the least of every salt for the next, coarser one: after
    the first, no task sorts more than 16 * ``most`` rows of a group.
    """
    salted = rows.withColumn("__salt", F.xxhash64(*order))
    for parts in SALTS:
        salted = salted.withColumn("__salt", F.pmod("__salt", F.lit(parts)))
        salted = salted.withColumn("__k", F.row_number().over(W.partitionBy(group, "__salt").orderBy(*order))).where(F.col("__k") <= most)
    return salted.drop("__salt", "__k")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one only for a local master without it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.gettempdir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads files that outlive any executor.

    A table rather than a checkpoint, as a checkpoint keeps the estimated sizes of the
    plan that it cuts.  Those of joins are products: in a loop the driver soon
    multiplies numbers of millions of digits.  Files have true sizes.

    Plans, broadcasts and shuffles of past steps stay until the driver collects its
    garbage.  Left to itself it lets its heap grow to the limit first, so every few
    tables it is told to.
    """
    path = f"{shared_folder(df.sparkSession)}/weirflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    if next(_TABLES) % TABLES_A_COLLECTION == 0:
        collected(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Lets go of what the driver no longer refers to; Python's references hold objects of the JVM, so its garbage goes first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a table; the tables that were cut for it go, as nothing reads them any more."""
    outer, made = _MADE.get(), []
    _MADE.set(made)
    try:
        out = cut(make())
    finally:
        _MADE.set(outer)
    if outer is not None:
        outer.append(made[-1])
    context = out.sparkSession.sparkContext
    for path in map(context._jvm.org.apache.hadoop.fs.Path, made[:-1]):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return out


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if a count has shown that it fits."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, table: DataFrame, key: str, other: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of one row a key, ``count`` being how many of the rows have it.

    A small table is broadcast.  Of a larger one the commonest keys are, of which
    there can't be more than ``HEAVY``; the rest is joined by a shuffle, in which no
    key has more than that part of the rows.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), F.col(key) == F.col(other), how)
    share = (table.agg(F.sum(count)).first()[0] or 0) / HEAVY
    hot, cold = table.where(F.col(count) > share), table.where(F.col(count) <= share)
    common = F.broadcast(hot.select(F.col(other).alias("__hot")))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col(other))
    return first.unionByName(rows.join(common, F.col(key) == F.col("__hot"), "left_anti").join(cold, F.col(key) == F.col(other), how))
