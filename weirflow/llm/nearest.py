"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Euclidean nearness becomes a largest inner product: with y = (x, -|x|^2 / 2) and
q' = (q, 1), q'.y is largest where |q - x| is smallest.  Vectors are dealt to
lists by coarse centres.  What remains of y is quantised with four bits for each
few dimensions; codes and codebooks are chosen by a loss that weighs the error
parallel to y more than the rest, since that error moves large inner products.
A query scans tables of 16 partial scores a subspace over its nearest lists and
reranks the best with exact distances in double precision.

Equal vectors are one entry that keeps its k + 1 smallest ids, found with a
per-task limit before the shuffle, so a large group of copies stays small and
ties go to the smallest ids.  Lists are cut into blocks of bounded size; the
queries of a list visit each block.  A query probes lists until they hold more
than k ids, whatever their number.

Centres and codebooks are fitted in numpy on at most ``SAMPLE`` distinct vectors
(smallest hash); every vector is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite
components, or differ in length from the most common length, take no part;
repeated rows of one id count once; of an id with several vectors a query takes
the one of least hash, and the nearest of them counts as a candidate; vectors at
equal distance come by id, among those that are reranked; with fewer candidates than k all are
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.llm.common import cut, read_table

K = 10
SAMPLE = 20_000
#: Lists at most; as many as half the root of the number of vectors below that.
LISTS = 4096
#: Share of a sample's true neighbours whose lists a query must reach; it sets the number of lists probed.
COVERAGE = 0.97
CHECKED = 200
#: Dimensions of a subspace; each has 16 code words.
DIMENSIONS = 4
#: Weight of the parallel error over that of the rest.
ETA = 4.0
#: Entries of a block, and how many of them are reranked for a query.
BLOCK = 4096
RERANK = 256
ROUNDS = 8


def usable(v: Column) -> Column:
    """Vectors without null or non-finite components that aren't zero."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def lifted(x: np.ndarray) -> np.ndarray:
    """(x, -|x|^2 / 2), padded with zeros to whole subspaces."""
    x = x.astype(np.float64)
    y = np.concatenate([x, -0.5 * (x * x).sum(axis=1, keepdims=True)], axis=1)
    return np.pad(y, ((0, 0), (0, -y.shape[1] % DIMENSIONS)))


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(p @ centres.T - half, axis=1) for p in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.empty(0, np.int64)


@dataclass
class Quantiser:
    centres: np.ndarray  # lists x dimensions
    lifted_centres: np.ndarray
    books: np.ndarray  # subspaces x 16 x DIMENSIONS
    scales: np.ndarray  # of what remains, by list: a tight list is quantised as finely as a loose one
    probes: int = 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest_centre(x.astype(np.float64), self.centres)

    def encode(self, x: np.ndarray, lists: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        y = lifted(x)
        rest = ((y - self.lifted_centres[lists]) / self.scales[lists, None]).reshape(len(x), -1, DIMENSIONS)
        unit = (y / np.linalg.norm(y, axis=1, keepdims=True)).reshape(rest.shape)
        plain = ((rest[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)  # rows x subspaces x 16
        codes = plain.argmin(axis=2)
        along = np.einsum("nsd,skd->nsk", unit, self.books)
        whole = (rest * unit).sum(axis=(1, 2))
        rows = np.arange(len(x))
        taken = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0]
        total = taken.sum(axis=1)
        for _ in range(passes):
            for s in range(codes.shape[1]):
                parallel = (whole - total + taken[:, s])[:, None] - along[:, s]
                codes[:, s] = (plain[:, s] + (ETA - 1) * parallel**2).argmin(axis=1)
                total += along[rows, s, codes[:, s]] - taken[:, s]
                taken[:, s] = along[rows, s, codes[:, s]]
        return codes


def fit(x: np.ndarray, n_lists: int, seed: int = 5) -> Quantiser:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    centres = lloyd(x, min(n_lists, len(x)), rng)
    lists = nearest_centre(x, centres)
    over = lifted(centres)
    y = lifted(x)
    rest = y - over[lists]
    n = np.bincount(lists, minlength=len(centres))
    squares = np.bincount(lists, weights=(rest**2).sum(axis=1), minlength=len(centres))
    usual = math.sqrt(squares.sum() / len(x)) or 1.0
    scales = np.where(squares > 0, np.sqrt(squares / np.maximum(n, 1)), usual)
    rest = (rest / scales[lists, None]).reshape(len(x), -1, DIMENSIONS)
    unit = (y / np.linalg.norm(y, axis=1, keepdims=True)).reshape(rest.shape)
    spread = rest.std(axis=(0, 1), keepdims=True).mean() + 1e-9
    books = np.stack([np.pad(b := lloyd(rest[:, s], min(16, len(x)), rng), ((0, 16 - len(b)), (0, 0))) for s in range(rest.shape[1])])
    books = books + rng.normal(0, 1e-6, books.shape) * spread
    q = Quantiser(centres, over, books, scales)
    for _ in range(ROUNDS):
        codes = q.encode(x, lists, passes=1)
        words = q.books[np.arange(books.shape[0])[None], codes]  # rows x subspaces x DIMENSIONS
        parallel = (rest * unit).sum(axis=(1, 2)) - (words * unit).sum(axis=(1, 2))
        for s in range(books.shape[0]):
            own = parallel + (words[:, s] * unit[:, s]).sum(axis=1)  # parallel error left to this subspace
            for c in range(16):
                m = codes[:, s] == c
                if m.any():
                    u = unit[m, s]
                    left = m.sum() * np.eye(DIMENSIONS) + (ETA - 1) * u.T @ u
                    q.books[s, c] = np.linalg.solve(left, rest[m, s].sum(axis=0) + (ETA - 1) * (own[m, None] * u).sum(axis=0))
    q.probes = needed_probes(x, centres, lists, rng)
    return q


def needed_probes(x: np.ndarray, centres: np.ndarray, lists: np.ndarray, rng: np.random.Generator, k: int = K) -> int:
    """Lists that a query must visit to reach COVERAGE of its true neighbours, measured on the sample."""
    ranks = []
    half, whole = 0.5 * (centres**2).sum(axis=1), 0.5 * (x**2).sum(axis=1)
    for r in rng.permutation(len(x))[:CHECKED]:
        far = whole - x @ x[r]
        far[r] = np.inf
        true = np.argpartition(far, min(k, len(x) - 1))[:k] if len(x) > 1 else np.array([r])
        place = np.empty(len(centres), np.int64)
        place[np.argsort(half - centres @ x[r], kind="stable")] = np.arange(len(centres))
        ranks.append(place[lists[true]])
    return int(np.quantile(np.concatenate(ranks), COVERAGE)) + 1


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def entries(vectors: DataFrame, k: int, vec_id: str, vector: str) -> DataFrame:
    """One row for each distinct vector: ``h``, ``g``, its ``ids`` (k + 1 smallest) and ``v`` (doubles)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is not None:
        rows = rows.where(F.size("v") == top["n"])
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    few = rows.withColumn("k", F.rank().over(W.partitionBy("h", "g").orderBy("id"))).where(F.col("k") <= k + 1)
    few = few.dropDuplicates(["h", "g", "id"])
    return few.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("v").alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows found for each query but its own."""
    spark = vectors.sparkSession
    have = cut(entries(vectors, k, vec_id, vector))
    n = have.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    some = have.orderBy("h", "g").limit(SAMPLE).select("v")
    quantiser = fit(np.array([r["v"] for r in some.collect()]), max(1, min(LISTS, int(math.sqrt(n) / 2))))
    width, probes = quantiser.centres.shape[1], probes or quantiser.probes
    shared = spark.sparkContext.broadcast(quantiser)  # at most LISTS centres

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"))
                lists = own.assign(x)
                codes = own.encode(x, lists).astype(np.uint8)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in packed], pa.binary()), part.column("h"), part.column("ids"), part.column("v")], ["list", "codes", "h", "ids", "v"])

    indexed = cut(have.select("h", "ids", "v").mapInArrow(index, "list int, codes binary, h long, ids array<long>, v array<double>"))
    sizes = {r["list"]: (r["n"], r["ids"]) for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}  # at most LISTS rows
    blocks = {c: -(-m // BLOCK) for c, (m, _) in sizes.items()}
    held = np.array([sizes.get(c, (0, 0))[1] for c in range(len(quantiser.centres))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q = _matrix(part.column("v"))
                order = np.argsort(0.5 * (own.centres**2).sum(axis=1) - q @ own.centres.T, axis=1, kind="stable")
                filled = np.cumsum(held[order], axis=1)
                enough = np.maximum((filled <= k).sum(axis=1) + 1, (np.cumsum(held[order] > 0, axis=1) < probes).sum(axis=1) + 1)
                row, lists, block = [], [], []
                for r in range(len(q)):
                    for c in order[r, : enough[r]].tolist():
                        for b in range(blocks.get(c, 0)):
                            row.append(r)
                            lists.append(c)
                            block.append(b)
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("v"), pa.array(lists, pa.int32()), pa.array(block, pa.int32())], ["query_id", "v", "list", "block"])

    wanted = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    wanted = wanted.where(F.col("query_id").isNotNull() & usable(F.col("v")) & (F.size("v") == width))
    wanted = wanted.groupBy("query_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    visits = wanted.mapInArrow(probe, "query_id long, v array<double>, list int, block int")
    per_list = F.broadcast(spark.createDataFrame([(int(c), int(b)) for c, b in blocks.items()], "list int, blocks long"))  # at most LISTS rows
    stored = indexed.join(per_list, "list").withColumn("block", F.pmod(F.col("h"), F.col("blocks")).cast("int")).drop("blocks")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        own = shared.value
        x, ids = _matrix(left["v"]), left["ids"].to_pylist()
        least = np.array([i[0] for i in ids])
        packed = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(x), -1)
        q, asked = _matrix(right["v"]), right["query_id"].to_pylist()
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            y = np.pad(np.concatenate([part, np.ones((len(part), 1))], axis=1), ((0, 0), (0, own.lifted_centres.shape[1] - width - 1)))
            tables = np.einsum("qsd,skd->qsk", y.reshape(len(part), -1, DIMENSIONS), own.books).astype(np.float32)  # one list: its centre and scale keep the order
            guess = np.zeros((len(part), len(x)), np.float32)
            for s in range(tables.shape[1]):
                guess += tables[:, s, codes[:, s]]
            many = min(RERANK, len(x))
            best = np.argpartition(-guess, many - 1, axis=1)[:, :many]
            for r in range(len(part)):
                d = np.sqrt(((x[best[r]] - part[r]) ** 2).sum(axis=1))
                near: dict[int, float] = {}
                # entries by distance, ties by their least id: k + 1 of them hold k ids but the query's own, unless an id has several vectors
                for j in np.lexsort((least[best[r]], d)).tolist():
                    if len(near) >= k and d[j] > worst:
                        break
                    for i in ids[best[r, j]]:
                        if i != asked[at + r]:
                            near.setdefault(i, float(d[j]))
                    worst = float(d[j])
                out += [(asked[at + r], i, s) for s, i in sorted((s, i) for i, s in near.items())[:k]]
        if not out:
            return empty
        a, b, c = zip(*out, strict=True)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = stored.groupBy("list", "block").cogroup(visits.groupBy("list", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    found = found.repartition("query_id")  # for both windows
    once = F.row_number().over(W.partitionBy("query_id", "vec_id").orderBy("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    found = found.withColumn("once", once).where("once = 1").withColumn("rank", place)
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
