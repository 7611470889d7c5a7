"""Resumable work: content keys, a ledger of what is done, and its streaming twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def content_key(df: DataFrame) -> Column:
    """sha256 of the row as JSON with sorted keys, nulls kept: the same for equal rows in any process."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def keyed(df: DataFrame, key: str = "_key") -> DataFrame:
    """Rows with their content key, equal ones once; a given ``_key`` is kept."""
    return (df if key in df.columns else df.withColumn(key, content_key(df))).dropDuplicates([key])


def remaining(work: DataFrame, ledger: DataFrame, key: str = "_key") -> DataFrame:
    """Elements that the ledger doesn't call done; failures run again."""
    return work.join(ledger.where(F.col("status") == "done").select(key), key, "left_anti")


def progress(ledger: DataFrame, job: str = "job") -> DataFrame:
    return ledger.groupBy(job).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, ledger: Callable[[int], bool] = lambda batch: False) -> StreamingQuery:
    """Everything there is now, in micro-batches; a batch that the ledger knows isn't written again."""

    def once(batch: DataFrame, batch_id: int) -> None:
        if not ledger(batch_id):
            write(batch, batch_id)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
