"""Shards: records by ascending id in Parquet, with a header that readers insist on."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shard(records: DataFrame, path: str, dataset_id: str, shard_id: int, base_id: int, slots: int, kind: str = "record", serializer: str = "bytes", files: int = 1) -> dict:
    """Writes ``id``, ``record`` with each record's checksum; ids are unique and in [base_id, base_id + slots).

    Holes are allowed; the header's slot_count ends with the last id.  Data comes
    first, the header last, so a shard without a header isn't one.
    """
    rows = records.select(F.col("id").cast("long").alias("id"), F.col("record").cast("binary").alias("record"))
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if seen["n"] != seen["ids"]:
        raise ValueError("an id comes twice or is null")
    if seen["n"] and not base_id <= seen["lo"] <= seen["hi"] < base_id + slots:
        raise ValueError(f"ids must lie in [{base_id}, {base_id + slots})")
    header = {"dataset_id": dataset_id, "shard_id": shard_id, "base_id": base_id, "slot_count": seen["hi"] - base_id + 1 if seen["n"] else 0, "kind": kind, "serializer": serializer, "n_records": seen["n"]}
    rows = rows.withColumn("crc", F.crc32("record"))
    rows.repartitionByRange(files, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/records")
    records.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return header


class Shard:
    """A shard that is read by id; a lookup prunes row groups by their id ranges."""

    def __init__(self, spark: SparkSession, path: str, dataset_id: str | None = None):
        self.header = json.loads(spark.read.text(f"{path}/header").first()[0])
        if dataset_id is not None and self.header["dataset_id"] != dataset_id:
            raise ValueError(f"a shard of {self.header['dataset_id']}, not {dataset_id}")
        self.df = spark.read.parquet(f"{path}/records")

    def records(self) -> DataFrame:
        return self.df.select("id", "record")

    def __len__(self) -> int:
        return self.header["n_records"]

    def __contains__(self, id_: int) -> bool:
        return not self.df.where(F.col("id") == id_).isEmpty()

    def __getitem__(self, id_: int) -> bytes:
        got = self.df.where(F.col("id") == id_).select("record").take(1)
        if not got:
            raise KeyError(id_)
        return bytes(got[0][0])

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        return ((r["id"], bytes(r["record"])) for r in self.records().orderBy("id").toLocalIterator())

    def many(self, ids: Sequence[int] | DataFrame) -> DataFrame:
        if not isinstance(ids, DataFrame):
            return self.records().where(F.col("id").isin(list(ids)))
        return self.records().join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")

    def verify(self) -> DataFrame:
        """Records whose bytes don't match their checksum, and ids outside of the header's range."""
        lo, n = self.header["base_id"], self.header["slot_count"]
        return self.df.where((F.crc32("record") != F.col("crc")) | (F.col("id") < lo) | (F.col("id") >= lo + n)).select("id")
