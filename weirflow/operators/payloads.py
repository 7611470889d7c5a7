"""Payload tables: enrichment, lookups that insist on every id, integrity and compaction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(rows: DataFrame, payloads: DataFrame, fields: Sequence[str], payload_id: str = "id", data: str = "data") -> DataFrame:
    """Each id field's payload beside it as ``<field>_data``; a null id has none."""
    for f in fields:
        side = payloads.select(F.col(payload_id).alias("__id"), F.col(data).alias(f"{f}_data"))
        rows = rows.join(side, F.col(f) == F.col("__id"), "left").drop("__id")
    return rows


def get_many(payloads: DataFrame, ids: DataFrame, payload_id: str = "id", kind: str | None = None, kinds: str = "kind") -> DataFrame:
    """The asked payloads, each once, in the order of ``seq`` if the ids carry one; a missing id, or one of another kind, is an error."""
    name = next(c for c in ids.columns if c != "seq")
    asked = ids.groupBy(F.col(name).alias(payload_id)).agg((F.min("seq") if "seq" in ids.columns else F.lit(0)).alias("__seq"))
    have = payloads.where(F.col(kinds) == kind) if kind is not None else payloads
    missing = asked.join(have.select(payload_id), payload_id, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0][0])
    out = have.join(asked, payload_id)
    return (out.orderBy("__seq") if "seq" in ids.columns else out).drop("__seq")


def put(payloads: DataFrame, rows: DataFrame, field: str, kind: str, payload_id: str = "id", data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Stores the bytes in a column of rows, equal ones once, and swaps them for ids.

    Returns all payloads and the rows with ``<field>_id``; ids follow on the largest,
    in the order of the bytes' hash; null bytes have no id.
    """
    from weirflow.sources.reads import numbered

    sha = F.sha2(field, 256)
    new = rows.where(F.col(field).isNotNull()).groupBy(sha.alias("__sha")).agg(F.any_value(F.col(field)).alias(data))
    old = payloads.select(F.sha2(data, 256).alias("__sha"), F.col(payload_id).alias("__old")).groupBy("__sha").agg(F.min("__old").alias("__old"))
    fresh = numbered(new.join(old, "__sha", "left_anti").withColumn("__h", F.xxhash64("__sha")), "__h", "__n")
    top = payloads.agg(F.coalesce(F.max(payload_id), F.lit(0))).first()[0]
    fresh = fresh.withColumn(payload_id, F.col("__n") + F.lit(top) + 1)
    ids = old.withColumnRenamed("__old", "__id").unionByName(fresh.select("__sha", F.col(payload_id).alias("__id")))
    stored = payloads.unionByName(fresh.select(payload_id, data, F.lit(kind).alias("kind"), F.crc32(data).alias("crc")), allowMissingColumns=True)
    out = rows.withColumn("__s", sha).join(ids, F.col("__s") == F.col("__sha"), "left").withColumn(f"{field}_id", F.col("__id")).drop(field, "__s", "__sha", "__id")
    return stored, out


def release(payloads: DataFrame, ids: DataFrame, references: Sequence[tuple[DataFrame, str]], payload_id: str = "id") -> DataFrame:
    """``payloads`` without those of the ids that nothing refers to any more."""
    asked = ids.select(F.col(ids.columns[0]).alias(payload_id)).distinct()
    free = unreferenced(asked, references, payload_id)
    return payloads.join(free, payload_id, "left_anti")


def check(payloads: DataFrame, volumes: DataFrame, references: Sequence[tuple[DataFrame, str]], payload_id: str = "id", data: str = "data", crc: str = "crc", full: bool = True) -> DataFrame:
    """One row for each fault found: ``fault``, ``id``, in any order.

    broken (bytes don't match), no_volume (in a volume that isn't listed), unreferenced,
    dangling (referred to, not stored), empty (a volume without payloads).
    """
    faults = [("no_volume", payloads.join(volumes.select("volume_id"), "volume_id", "left_anti").select(payload_id)), ("unreferenced", unreferenced(payloads, references, payload_id).select(payload_id)), ("empty", volumes.join(payloads.select("volume_id"), "volume_id", "left_anti").select("volume_id"))]
    if full:
        faults.append(("broken", broken(payloads, data, crc).select(payload_id)))
    for df, column in references:
        named = df.select(F.col(column).alias(payload_id)).where(F.col(payload_id).isNotNull()).distinct()
        faults.append(("dangling", named.join(payloads.select(payload_id), payload_id, "left_anti")))
    parts = [df.select(F.lit(name).alias("fault"), F.col(df.columns[0]).cast("long").alias("id")) for name, df in faults]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_compact(stats: DataFrame, min_dead: float = 0.25, small: int = 1 << 20) -> DataFrame:
    """Volumes worth a rewrite: so much of them dead, or small ones if there are two or more."""
    little = stats.where(F.col("size") < small)
    twice = F.broadcast(little.agg((F.count("*") >= 2).alias("__two")))
    return stats.crossJoin(twice).where((F.col("dead_share") >= min_dead) | (F.col("__two") & (F.col("size") < small))).drop("__two")


def located(payloads: DataFrame, volumes: DataFrame, series: str | None = None) -> DataFrame:
    """Payloads with their volumes, of one series if it is named."""
    side = volumes.where(F.col("series") == series) if series is not None else volumes
    return payloads.join(side, "volume_id")


def windows(payloads: DataFrame, order: str = "id", window: int = 500) -> Iterator[list[tuple[int, bytes]]]:
    """(id, bytes) in order, ``window`` at a time; the driver holds one partition and one window."""
    page: list[tuple[int, bytes]] = []
    for r in payloads.orderBy(order).toLocalIterator():
        page.append((r["id"], bytes(r["data"])))
        if len(page) == window:
            yield page
            page = []
    if page:
        yield page


def unreferenced(payloads: DataFrame, references: Sequence[tuple[DataFrame, str]], payload_id: str = "id") -> DataFrame:
    """Payloads that no referencing column of any table names."""
    for df, column in references:
        payloads = payloads.join(df.select(F.col(column).alias(payload_id)).where(F.col(payload_id).isNotNull()), payload_id, "left_anti")
    return payloads


def volume_stats(needles: DataFrame, volumes: DataFrame, header: int = 16, file_header: int = 32) -> DataFrame:
    """Live bytes, recovery end and dead share of each volume, from distinct needles."""
    live = needles.dropDuplicates(["volume_id", "offset", "length"]).groupBy("volume_id").agg(F.sum(F.col("length") + header).alias("live"), F.max(F.col("offset") + F.col("length")).alias("end"))
    out = volumes.join(live, "volume_id", "left")
    dead = F.round(1 - F.coalesce("live", F.lit(0)) / F.greatest(F.col("size") - file_header, F.lit(1)), 4)
    return out.select("volume_id", "size", F.coalesce("live", F.lit(0)).alias("live_bytes"), "end", dead.alias("dead_share"))


def broken(payloads: DataFrame, data: str = "data", crc: str = "crc") -> DataFrame:
    """Payloads whose bytes don't match their checksum."""
    return payloads.where(F.crc32(data) != F.col(crc))


def compact(payloads: DataFrame, order_by: str, parts: int) -> DataFrame:
    """Rows in key ranges and order, for a rewrite."""
    return payloads.repartitionByRange(parts, order_by).sortWithinPartitions(order_by)
