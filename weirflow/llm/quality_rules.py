"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column over the raw text that is true where the text is
rejected.  Before a run every rule is timed on a sample and its share of
rejections noted; the cascade then tests the rule with the most rejections per
second first, and a text that one rule has rejected never pays for the rest.
The order changes cost only: the set of kept rows is the same for any order.

Defined results: a null text counts as empty; an empty text has zero words and
fails the base; repeated rows are judged alike, each on its own; an empty table
gives an empty result; columns of the input that carry an output's name are
replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import WORD, let, read_table, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 400


# -- features ---------------------------------------------------------------


def clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(clean(text), F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(clean(text), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, width: int = 3, few: int = 48) -> Column:
    """Words covered by windows of ``width`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes.  Most texts repeat none, which a hash
    set tells; for the others the repeated hashes are found by sorting, their
    places by membership (``few`` of them) or by sorting hashes with places, and
    the union of the spans is counted.
    """

    def hashes(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        return F.slice(every, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))

    def repeated(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))

    def by_membership(h: Column, r: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(r, x), i)), lambda i: i.isNotNull())

    def by_sorting(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def count(h: Column) -> Column:
        some = let(repeated(h), lambda r: covered(F.when(F.size(r) <= few, by_membership(h, r)).otherwise(by_sorting(h))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    return let(words, lambda w: let(hashes(w), count))


# -- rules ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true where a row fails; ``text`` and ``words`` columns are at hand."""

    name: str
    rejects: Column


def features(text: str = "text", words: str = "__words") -> dict[str, Column]:
    t, w = F.col(text), F.col(words)
    return {"n_words": n_words(w), "word_chars": word_chars(w), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(w)}


def base_rules(f: dict[str, Column], min_words: int = 50, repeat_percent: int = 50) -> list[Rule]:
    return [
        Rule("too_short", f["n_words"] < min_words),
        Rule("repetitive", 100 * f["n_repeat_words"] > repeat_percent * f["n_words"]),
    ]


def more_rules(f: dict[str, Column], text: str = "text", symbol_percent: int = 10, dup_line_percent: int = 50, min_mean: float = 2.0, max_mean: float = 14.0, shout_percent: int = 25) -> list[Rule]:
    """Symbols and shouts per hundred words, repeated lines per hundred lines, mean word length."""
    t = clean(F.col(text))
    n_lines = F.regexp_count(t, F.lit("\n")) + 1
    return [
        Rule("symbols", 100 * f["n_symbols"] > symbol_percent * f["n_words"]),
        Rule("repeated_lines", (f["n_dup_lines"] > 0) & (100 * f["n_dup_lines"] > dup_line_percent * n_lines)),
        Rule("word_length", (f["word_chars"] < min_mean * f["n_words"]) | (f["word_chars"] > max_mean * f["n_words"])),
        Rule("shouting", t.contains("!!") & (100 * F.regexp_count(t, F.lit("!!")) > shout_percent * f["n_words"])),
    ]


# -- cascade ----------------------------------------------------------------


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def estimate(df: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Cost and selectivity of each rule on about ``rows`` random rows (``df`` holds their ``__words``)."""
    total = df.count()
    share = min(1.0, rows / max(total, 1))
    sample = df.sample(share, seed).persist()
    try:
        n = max(sample.count(), 1)
        out = []
        for rule in rules:
            query, took = sample.select(F.count_if(rule.rejects).alias("n")), []
            for _ in range(2):  # the first run also compiles
                began = time.perf_counter()
                hit = query.first()["n"]
                took.append(time.perf_counter() - began)
            out.append(Estimate(rule.name, max(min(took), 1e-4), hit / n))
        return out
    finally:
        sample.unpersist()


def ordered(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """By rejection per cost, largest first; ties by name."""
    gain = {e.name: e.gain for e in estimates}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def first_failure(rules: Sequence[Rule]) -> Column:
    """Name of the first rule of the cascade that rejects the row, else null; later ones aren't evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects, F.lit(r.name)) if out is None else out.when(r.rejects, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the base features, ``base_failed``, ``failed_rule`` and ``kept``."""
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")
    rows = docs.drop(*outputs).withColumn("__words", words_of(F.col(text)))
    f = features(text)
    order = ordered(more_rules(f, text), estimate(rows, more_rules(f, text)))
    named = {k: F.col(k) for k in f}  # the base is asked for in any case, so the cascade reads it
    rank = [r.name for r in order]
    cascade = sorted(more_rules(named, text), key=lambda r: rank.index(r.name))
    base = base_rules(named)
    out = rows.withColumns(f)
    out = out.withColumn("base_failed", base[0].rejects | base[1].rejects)
    out = out.withColumn("failed_rule", F.when(~F.col("base_failed"), first_failure(cascade)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("__words")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that every rule accepts, with their own columns only."""
    rows = docs.withColumn("__words", words_of(F.col(text)))
    f = features(text)
    rules = base_rules(f) + more_rules(f, text)
    cascade = ordered(rules, estimate(rows, rules))
    return rows.where(first_failure(cascade).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, t, w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), m AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY doc_id
), f AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines, len(regexp_extract_all(t, '!!')) AS shouts
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * n_words AS bad_symbols, 100 * n_dup_lines > 50 * n_lines AS bad_lines,
         word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words AS bad_length, 100 * shouts > 25 * n_words AS bad_shouts
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad_symbols AND NOT bad_lines AND NOT bad_length AND NOT bad_shouts AS kept
FROM v
"""
