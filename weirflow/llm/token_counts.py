"""Token counts from an exact length histogram.

Documents are counted by their encoded length.  Suffix sums over the histogram
then answer, for every context limit, how many documents and tokens there are,
at which quantile the limit stands, and how many tokens are left when every
document is cut at it.  The sums run in two levels, within blocks of lengths and
over the blocks, so no task sees more than a block's lengths or the blocks.

Defined results: a null or empty text has length 0 and is counted; repeated rows
count each time; an empty table gives an empty result, and no totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.llm import bpe
from weirflow.llm.common import cut, read_table

#: Lengths in a block of the two-level sums.
BLOCK = 4096


def histogram(docs: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Documents by length: ``n_tokens``, ``n_docs``."""
    return docs.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length L that occurs, with what every context limit needs.

    docs_at_least and tokens_at_least count documents of L tokens or more;
    truncated_tokens is the total when every document is cut at L; quantile is
    the share of documents of at most L tokens.
    """
    rows = hist.withColumn("b", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    later = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        "b",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    own = W.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({"od": F.sum("n_docs").over(own), "ot": F.sum(tokens).over(own)}).join(blocks, "b")
    out = out.withColumns({"docs_at_least": F.col("od") + F.col("later_docs"), "tokens_at_least": F.col("ot") + F.col("later_tokens")})
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        "all_docs",
        "all_tokens",
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``limit_tokens``, ``docs_over`` (longer ones) and ``truncated_tokens`` for any limits, whether they occur as lengths or not."""
    def longer(at: int):
        row = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
        return F.min(F.when(F.col("n_tokens") > at, row)).alias(f"l{at}")

    one = sums.agg(F.max("all_tokens").alias("total"), *[longer(x) for x in limits])
    answers = [
        F.struct(
            F.lit(x).cast("long").alias("limit_tokens"),
            F.coalesce(F.col(f"l{x}.docs_at_least"), F.lit(0)).alias("docs_over"),
            (F.col("total") - F.coalesce(F.col(f"l{x}.tokens_at_least") - x * F.col(f"l{x}.docs_at_least"), F.lit(0))).alias("truncated_tokens"),
        )
        for x in limits
    ]
    return one.select(F.explode(F.array(*answers)).alias("a")).select("a.*")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least each share of the documents doesn't exceed: ``share``, ``n_tokens``."""
    one = sums.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(shares)])
    answers = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(shares)]
    return one.select(F.explode(F.array(*answers)).alias("a")).select("a.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of suffix sums over all documents."""
    # read twice by the sums: one row a length is kept rather than all texts encoded again
    return suffix_sums(cut(histogram(bpe.count(read_table(spark, sf_dir, "documents").select("text")))))
