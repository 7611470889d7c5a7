"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

A document's set holds hashes of its distinct 5-word shingles.  Two sets link
when 100 * |intersection| >= 75 * |union|.  Equal sets are one class, and the
join runs between classes.

Light side.  A set of at most x shingles emits, for every partner size that could
link, all its subsets of the least overlap; sharing one is to link.  Heavy side.
A set that may link to one of more than x emits its prefix: shingles in a global
order, rarest first, as many as any linked partner must share one of.  The
boundary x is the one of least cost over the histogram of set sizes.  The order
comes from a fixed-size count sketch of all shingles; it only orders, so its
errors cost time and never links.

Lists.  Keys met in two classes or more are inverted into lists.  A first round
compares every member with three classes of its list, and links are merged into
components.  Pairs of members not picked are left: further rounds compare those
outside of their list's largest component with some of its members, the last one
with all members of other components.  Any other pair of a list is in one
component by then, so no link between components is missed and no group of
copies is expanded into all its pairs.  Candidates pass a bound from parity
bitmaps (never too strict), those of long texts a second one from bitmaps that grow
with the set, then exact sets decide.

Defined results: null, empty and blank texts have an empty set and are their own
component; fewer words than five are one shingle; repeated rows share a class; a
null doc_id never names a component unless all its members are null; an empty
table gives an empty result.  Equality of shingles and classes is that of 64-bit
hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.bpe import _text_sizes, chunks
from weirflow.llm.common import cut, read_table
from weirflow.llm.components import components
from weirflow.llm.words import Features, Words

WIDTH = 5
PERCENT = 75
#: Counters of the sketch that orders shingles, and bits of the filter of shared keys.
SKETCH = 1 << 21
FILTER_BITS = 1 << 26
SLICES = 32
#: Largest set size for which subsets are considered at all.
SUBSET_MOST = 16
#: What a list entry costs in subset keys: it is counted, fetched and checked.
ENTRY_COST = 4.0
#: Rounds that compare a list's unlinked members with a few others, before the one that compares what is left.
TURNS = 2
#: Bits of the parity bitmap.
BITMAP = 1024
#: Up to so many rows (class, doc_id, hash) a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, k + 1, 1 << 64) for k in range(64)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _MIX
        return x ^ (x >> np.uint64(32))


# -- sets ---------------------------------------------------------------------


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


class Sets:
    """Shingle sets of texts; words are hashed once for each distinct one."""

    def __init__(self, width: int = WIDTH):
        self.width, self.store = width, Features(word_hashes)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        words = Words(pc.ascii_lower(pc.fill_null(texts, "")))
        hashes = self.store.of(words.distinct)[words.at]
        k, n = self.width, len(hashes)
        with np.errstate(over="ignore"):
            every = sum((hashes[j : max(n - k + 1 + j, 0)] * _POWERS[j] for j in range(k)), np.zeros(max(n - k + 1, 0), np.uint64))
            every = _mixed(every)
            out = []
            for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
                if b - a >= k:
                    out.append(np.unique(every[a : b - k + 1]))
                elif b > a:
                    own = hashes[a:b]
                    out.append(_mixed(np.array([(own * _POWERS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
                else:
                    out.append(np.empty(0, np.uint64))
        return out


def class_of(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes()))))


def overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def smallest_partner(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def largest_partner(n: int, percent: int = PERCENT) -> int:
    return 100 * n // percent


def prefix(n: int, percent: int = PERCENT) -> int:
    """Shingles of which any linked set shares one."""
    return n - smallest_partner(n, percent) + 1 if n else 0


@lru_cache(maxsize=256)
def subset_sizes(n: int, x: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(smaller size, larger size, least overlap) for partners of at most x shingles."""
    partners = range(smallest_partner(n, percent), min(largest_partner(n, percent), x) + 1)
    return tuple((min(n, m), max(n, m), overlap(n, m, percent)) for m in partners)


def subset_cost(n: int, x: int, percent: int = PERCENT) -> int:
    return sum(comb(n, o) for _, _, o in subset_sizes(n, x, percent))


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The size up to which subsets are enumerated: least cost over the small sizes' histogram."""

    def cost(x: int) -> float:
        light = sum(c * subset_cost(n, x, percent) for n, c in histogram.items() if 0 < n <= x)
        heavy = sum(c * ENTRY_COST * prefix(n, percent) for n, c in histogram.items() if n >= smallest_partner(x + 1, percent))
        return light + heavy

    return min(range(SUBSET_MOST + 1), key=lambda x: (cost(x), x))


def keys_of(s: np.ndarray, sketch: np.ndarray, x: int, percent: int = PERCENT) -> np.ndarray:
    """Subset keys, prefix shingles, or both, of a set."""
    n, out = len(s), []
    if 0 < n <= x:
        values = s.tolist()
        for a, b, o in subset_sizes(n, x, percent):
            tag = f"{a},{b},{o}:".encode()
            out += [xxhash.xxh64_intdigest(tag + np.array(c, np.uint64).tobytes()) for c in combinations(values, o)]
    keys = np.array(out, np.uint64)
    if n and n >= smallest_partner(x + 1, percent):
        order = np.lexsort((s, sketch[(s % np.uint64(len(sketch))).astype(np.int64)]))
        keys = np.concatenate([keys, s[order[: prefix(n, percent)]]])
    return keys.view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of BITMAP cells; cells that differ are shingles that differ, or more."""
    cells = np.bincount(((s >> np.uint64(17)) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """The like over at least two cells a shingle, a power of two; none where ``bitmap`` has as many."""
    if 2 * len(s) <= BITMAP:
        return None
    cells = 1 << (2 * len(s) - 1).bit_length()
    return np.packbits((np.bincount(((s >> np.uint64(17)) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def wide_may_link(a: bytes, b: bytes, sizes: int, percent: int = PERCENT) -> bool:
    """False only for sets that can't link; ``sizes`` is the sum of theirs.  The larger bitmap is folded to the smaller's cells."""
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (a, b)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)))
    return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * sizes


# -- fixed-size summaries of all rows -------------------------------------------


def _packed(slices: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(range(len(slices)), pa.int32()), "v": pa.array([zlib.compress(x.tobytes(), 1) for x in slices], pa.binary())})


def _merged(parts: DataFrame, kind: str, merge: np.ufunc) -> dict[int, np.ndarray]:
    """Each slice of the arrays (``k``, ``v``) that the tasks have made, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(v), kind)
                got[k] = merge(got[k], new) if k in got else new
        if got:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(got), pa.int32()), "v": pa.array([zlib.compress(x.tobytes(), 1) for x in got.values()], pa.binary())})

    rows = parts.repartition(SLICES, "k").mapInArrow(run, "k int, v binary").collect()
    return {r["k"]: np.frombuffer(zlib.decompress(r["v"]), kind) for r in rows}


def summaries(docs: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Sketch of shingle counts over all rows, and the histogram of set sizes up to 2 * SUBSET_MOST."""
    sizes = 2 * SUBSET_MOST

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, cells, hist = Sets(), np.zeros(SKETCH, np.int64), np.zeros(sizes + 1, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in chunks(_text_sizes(texts)):
                own = sets.of(texts.slice(a, b - a))
                cells += np.bincount((np.concatenate(own) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) if own else 0
                hist += np.bincount([len(s) for s in own if len(s) <= sizes], minlength=sizes + 1)
        yield _packed([*np.split(cells, SLICES), hist])

    got = _merged(docs.select("text").mapInArrow(count, "k int, v binary"), "int64", np.add)
    empty = np.zeros(SKETCH // SLICES, np.int64)
    sketch = np.concatenate([got.get(k, empty) for k in range(SLICES)])
    return np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32), {n: int(c) for n, c in enumerate(got.get(SLICES, [])) if c}


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits for the keys of a one-column table, of a fixed size: no false misses."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits.any():
            yield _packed(np.split(bits, SLICES))

    got = _merged(keys.mapInArrow(mark, "k int, v binary"), "uint8", np.bitwise_or)
    empty = np.zeros(FILTER_BITS // 8 // SLICES, np.uint8)
    return np.concatenate([got.get(k, empty) for k in range(SLICES)])


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(11)).astype(np.int64) % FILTER_BITS


# -- join -----------------------------------------------------------------------

_ROWS = "doc_id long, text_hash long, n long, class long, bits array<long>, wide binary, keys array<long>"


def class_rows(docs: DataFrame, sketch: np.ndarray, x: int) -> DataFrame:
    """Each row's set size, class, bitmaps and keys, in place of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # SKETCH counters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            for a, b in chunks(_text_sizes(batch.column(2))):
                part = batch.slice(a, b - a)
                own = sets.of(part.column(2))
                keys = [keys_of(s, shared.value, x) for s in own]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(s) for s in own], pa.int64()), pa.array([class_of(s) for s in own], pa.int64()),
                        pa.array([bitmap(s) for s in own], pa.list_(pa.int64())), pa.array([wide_bitmap(s) for s in own], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys), pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n", "class", "bits", "wide", "keys"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, _ROWS)


def list_members(rows: DataFrame) -> DataFrame:
    """``key``, ``class``: keys of two classes or more, each class once."""
    keyed = rows.select("class", F.explode("keys").alias("key"))
    multi = cut(keyed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key"))
    shared = rows.sparkSession.sparkContext.broadcast(key_filter(multi))  # FILTER_BITS bits

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys = batch.column(1)
            owner = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(keys).to_numpy())
            flat = keys.flatten().to_numpy()
            at = _bits(flat)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_pydict({"class": pa.array(owner[hit], pa.int64()), "key": pa.array(flat[hit], pa.int64())})

    few = rows.select("class", "keys").mapInArrow(keep, "class long, key long")
    return cut(few.distinct().join(multi, "key"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class``, ``shingles`` for ``wanted`` classes, from the one document that each names."""
    few = wanted.select("class", "one")
    few = F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few
    texts = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__t"), "text")
    texts = texts.join(few, F.col("one.doc_id").eqNullSafe(F.col("__d")) & (F.col("one.text_hash") == F.col("__t"))).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            for a, b in chunks(_text_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"class": part.column(0), "shingles": pa.array([s.tobytes() for s in sets.of(part.column(1))], pa.binary())})

    return texts.mapInArrow(run, "class long, shingles binary")


def verified(pairs: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (``a`` < ``b``) that link: sizes, then bitmaps, wide ones too, then the sets of those left decide."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, right = (info.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    close = cut(one.join(left, "a").join(right, "b").where(may_link("na", "nb", "bitsa", "bitsb")).select("a", "b"))
    close = cut(wide_close(close, cut(info.join(named_by(close), "class").select("class", "n", "wide"))))
    sets = cut(shingle_sets(docs, info.join(named_by(close), "class")))
    full = close.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"})

    return cut(full.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long").distinct())


def named_by(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def wide_close(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs that may link by their wide bitmaps, or of which a class has none."""
    left, right = (info.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"wide{c}")) for c in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("widea", "wideb", "sizes"))
            keep = [x is None or y is None or wide_may_link(x, y, n) for x, y, n in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"})

    full = pairs.join(left, "a").join(right, "b").select("a", "b", "widea", "wideb", (F.col("na") + F.col("nb")).alias("sizes"))
    return full.mapInArrow(near, "a long, b long")


def may_link(na: str, nb: str, bits_a: str, bits_b: str) -> Column:
    """False only for pairs that can't link, by their sizes or by the cells in which their bitmaps differ."""
    apart = sum((F.bit_count(F.col(bits_a)[k].bitwiseXOR(F.col(bits_b)[k])) for k in range(BITMAP // 64)), F.lit(0))
    fits = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    return fits & ((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col(na) + F.col(nb)))


def stars(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each list's members with three of its classes; and the members of which pairs are left, those not picked where two or more are."""
    picks = F.array_distinct(F.array(F.min("class"), F.max("class"), F.min_by("class", F.xxhash64("class"))))
    lists = members.groupBy("key").agg(picks.alias("picks"), F.count("*").alias("n"))
    pairs = members.join(lists, "key").select(F.col("class").alias("a"), F.explode("picks").alias("b"))
    left = members.join(lists.where(F.col("n") - F.size("picks") > 1), "key").where(~F.array_contains("picks", F.col("class")))
    return pairs, cut(left.select("key", "class"))


def parted(left: DataFrame, labels: DataFrame) -> DataFrame:
    """``key``, ``class``, ``label`` and the list's largest component ``top``, for lists of several components."""
    found = left.join(labels, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("label", "class").alias("label"))
    sizes = found.groupBy("key", "label").count()
    largest = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels"))
    return found.join(largest.where("labels > 1").select("key", F.col("top.label").alias("top")), "key")


def to_some(found: DataFrame, turn: int, picks: int = 4) -> DataFrame:
    """Members outside of a list's largest component with some classes of it and some from outside, others each turn."""

    def some(inside: str) -> list[Column]:
        return [F.min_by(F.expr(f"CASE WHEN {inside} THEN class END"), F.when(F.expr(inside), F.xxhash64("class", F.lit(turn * picks + k)))) for k in range(picks)]

    of = found.groupBy("key").agg(F.array_distinct(F.array_compact(F.array(*some("label = top"), *some("label <> top")))).alias("picks"))
    return found.where("label <> top").join(of, "key").select(F.col("class").alias("a"), F.explode("picks").alias("b"))


def across(found: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs of a list's members that may link and aren't in one component, one of them outside of the list's largest."""
    found = found.join(info.select("class", "n", "bits"), "class")
    outside = found.where("label <> top").select("key", F.col("class").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("bits").alias("bitsa"))
    every = found.select(F.col("key").alias("other"), F.col("class").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("bits").alias("bitsb"))
    pairs = outside.join(every, (F.col("key") == F.col("other")) & (F.col("la") != F.col("lb")) & may_link("na", "nb", "bitsa", "bitsb"))
    return pairs.select("a", "b").distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``text_hash``, ``n``, ``class``, ...) and the classes' component ``labels``."""
    sketch, histogram = summaries(docs)
    rows = cut(class_rows(docs, sketch, boundary(histogram)))
    members = list_members(rows)
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    info = rows.select("class", "n", "bits", "wide", "doc_id", "text_hash").join(members.select("class").distinct(), "class")
    info = cut(info.groupBy("class").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("wide").alias("wide"), one))
    pairs, left = stars(members)
    found = verified(pairs, info, docs)
    labels = components(found)
    for turn in range(TURNS + 1):
        apart = cut(parted(left, labels))
        if apart.isEmpty():
            break
        found = cut(found.union(verified(to_some(apart, turn) if turn < TURNS else across(apart, info), info, docs)))
        labels = components(found)
    return rows, labels


def join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``class`` and ``component_id`` of each row."""
    rows, labels = links(docs)
    full = rows.where("n > 0")
    named = full.groupBy("class").agg(F.min("doc_id").alias("least")).join(labels, F.col("class") == F.col("node"), "left")
    named = named.select("class", "least", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "label").select("class", "component_id"))
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class")).join(named, "class", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least doc_id, one row of it; empty ones stay."""
    from pyspark.sql import Window as W

    made = join(docs.select("doc_id", "text"))
    keep = made.where(F.col("class").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col("class").isNotNull().alias("__full")).distinct()
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")))
    first = W.partitionBy("__d", "__h").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = rows.withColumn("__k", F.row_number().over(first)).where("__k = 1 or not __full")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
