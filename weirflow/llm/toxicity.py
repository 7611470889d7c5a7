"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its
first letters.  Filters of several widths slide over a text's words; each
filter's maximum over the whole text passes a ReLU, and a logistic unit gives
the raw score.  The first filter starts from the words' log odds, the rest at
random; Adam trains everything.  The gradient of a maximum touches one window a
filter and text, so training stays cheap.

Every labelled text of the learning fold is learned from, whole.  They are dealt by
a hash of the text into two halves, and each half into shards.  The words' log odds
are counted over all.  Each shard trains from its half's log odds, and the mean of
the shards' changes is added: of a half's, for its own network, and of all, for the
one that scores.  So each half's texts have a raw score by a network that has seen
none of them; from these scores, of all texts, for every language (as guessed from
the text, by the model of ``language_id``, learned from the same texts) a raw
threshold is chosen, and raw scores are shifted in log odds so that each language's
threshold lands on 0.7.  Changes and scores are added up as integers, in any order.

Defined results: null, empty and wordless texts score as a text without any hit;
repeated rows score alike; rows equal in id and text are learned from once, and an
id with both labels counts as toxic; with one label only, or none, every score is
0.5; an empty table gives an empty result; input columns with an output's name are
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm import language_id
from weirflow.llm.bpe import _text_sizes, chunks
from weirflow.llm.common import cut, held_out, read_table, small
from weirflow.llm.words import Features, Words

#: Labelled rows for each shard; about so many texts are trained on at a time.
SHARD = 2500
BUCKETS = 1 << 16
PREFIX_BUCKETS = 1 << 13
PREFIX = 5
EVERY = BUCKETS + PREFIX_BUCKETS
WIDTH = 8  # of an embedding
FILTERS = ((1, 8), (2, 4), (3, 4))  # (words, filters)
THRESHOLD = 0.7
EPOCHS = 4
BATCH = 32
#: Changes of parameters are added up in steps of this size, raw scores counted in steps of that, within these bounds.
CHANGE, STEP, FAR = 2.0**-24, 2.0**-10, 64.0


def word_buckets(words: list[str]) -> np.ndarray:
    """Bucket of the word and of its first letters; case and outer punctuation don't count."""
    out = np.empty((len(words), 2), np.int64)
    for k, w in enumerate(words):
        own = w.lower().strip(".,;:!?()[]{}\"'|*#$%&<>-_/").encode()
        out[k] = zlib.crc32(own) % BUCKETS, BUCKETS + zlib.crc32(own[:PREFIX]) % PREFIX_BUCKETS
    return out


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # words x WIDTH x filters
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    raw_threshold: dict[str | None, float] = field(default_factory=dict)  # log odds by language; of all, under None
    languages: language_id.Model | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.bias]

    def table(self) -> np.ndarray:
        """All parameters in rows of WIDTH, the embeddings first."""
        dense = np.concatenate([p.ravel() for p in self.parameters()[1:]])
        return np.concatenate([self.embedding, np.pad(dense, (0, -len(dense) % WIDTH)).reshape(-1, WIDTH)])

    def changed(self, change: np.ndarray) -> Network:
        """A network with ``change``, in rows as of ``table``, added."""
        table, at, made = self.table() + change.astype(np.float32), self.embedding.size, []
        for p in self.parameters()[1:]:
            made.append(table.ravel()[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        k = len(self.filters)
        return Network(table[: len(self.embedding)].copy(), made[:k], made[k : 2 * k], made[-2], made[-1])

    def pooled(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each text (before the ReLU), and the window where it is (or -1)."""
        vectors = self.embedding[ids[:, 0]] + self.embedding[ids[:, 1]]
        size, best, places = np.diff(offsets), [], []
        for f, b in zip(self.filters, self.biases, strict=True):
            k, _, n = f.shape
            value = np.full((len(size), n), -1e30, np.float32)
            place = np.full((len(size), n), -1, np.int64)
            if len(ids) >= k:
                windows = len(ids) - k + 1
                response = vectors[:windows] @ f[0]
                for j in range(1, k):
                    response += vectors[j : j + windows] @ f[j]
                own = np.flatnonzero(size >= k)
                bounds = np.stack([offsets[:-1][own], offsets[1:][own] - k + 1], axis=1).ravel()
                if len(own):
                    padded = np.concatenate([response, np.full((1, n), -1e30, np.float32)])
                    value[own] = np.maximum.reduceat(padded, bounds, axis=0)[::2]
                    if self.training:
                        for r, (a, z) in zip(own, bounds.reshape(-1, 2), strict=True):
                            place[r] = a + response[a:z].argmax(axis=0)
            best.append(value + b)
            places.append(place)
        return np.concatenate(best, axis=1), places

    training = False

    def raw(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of each text."""
        return np.maximum(self.pooled(ids, offsets)[0], 0) @ self.out + self.bias[0]


def start(hits: np.ndarray, texts: np.ndarray, seed: int = 3) -> Network:
    """An untrained network, from how many texts of each label hold each bucket, and how many there are."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.05, (EVERY, WIDTH)).astype(np.float32)
    odds = np.log((hits[1] + 0.5) / (texts[1] + 1)) - np.log((hits[0] + 0.5) / (texts[0] + 1))
    # few hits tell little: a word's odds shrink unless several texts agree
    embedding[:, 0] = odds * hits.sum(axis=0) / (hits.sum(axis=0) + 8)
    filters = [rng.normal(0, 0.3, (k, WIDTH, n)).astype(np.float32) for k, n in FILTERS]
    filters[0][0, :, 0] = np.eye(WIDTH, dtype=np.float32)[0]
    biases = [np.zeros(n, np.float32) for _, n in FILTERS]
    width = sum(n for _, n in FILTERS)
    out = np.full(width, 0.05, np.float32)
    out[0] = 1.0
    return Network(embedding, filters, biases, out, np.array([-3.0], np.float32))


def train(net: Network, ids: list[np.ndarray], labels: np.ndarray, seed: int = 3, epochs: int = EPOCHS, rate: float = 0.02) -> Network:
    """``net``, trained in place."""
    rng = np.random.default_rng(seed)
    net.training = True
    dense = net.parameters()[1:]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    squares = np.full(EVERY, 1e-6, np.float32)  # Adagrad for the embeddings, a row at a time
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            flat = np.concatenate([ids[r] for r in rows])
            offsets = np.concatenate([[0], np.cumsum([len(ids[r]) for r in rows])])
            pooled, places = net.pooled(flat, offsets)
            hidden = np.maximum(pooled, 0)
            raw = hidden @ net.out + net.bias[0]
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            back = np.where(pooled > 0, error[:, None] * net.out[None, :], 0).astype(np.float32)
            grads_f, grads_b, base = [], [], 0
            touched, values = [], []
            for f, place in zip(net.filters, places, strict=True):
                k, _, n = f.shape
                own = np.where(place >= 0, back[:, base : base + n], 0)
                grads_b.append(own.sum(axis=0))
                g = np.zeros_like(f)
                for j in range(k):
                    word = flat[np.maximum(place, 0) + j]  # texts x filters x 2
                    v = net.embedding[word[..., 0]] + net.embedding[word[..., 1]]
                    g[j] = np.einsum("tn,tnd->dn", own, v)
                    d = own[..., None] * f[j].T[None]
                    for c in (0, 1):
                        touched.append(word[..., c].ravel())
                        values.append(d.reshape(-1, WIDTH))
                grads_f.append(g)
                base += n
            grads = [*grads_f, *grads_b, hidden.T @ error.astype(np.float32) + 1e-4 * net.out, np.array([error.sum()], np.float32)]
            step += 1
            for p, g, a, b in zip(dense, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(where), WIDTH), np.float32)
            np.add.at(g, inverse, np.concatenate(values))
            squares[where] += (g * g).mean(axis=1)
            net.embedding[where] -= 0.05 * g / np.sqrt(squares[where])[:, None]
    net.training = False
    return net


def best_threshold(raw: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Log odds that part the labels with the fewest errors, in the middle of the widest such gap.

    ``counts`` tells how often each score and label occurs, if not once.
    """
    counts = np.ones(len(raw)) if counts is None else counts
    raw, at = np.unique(raw, return_inverse=True)
    toxic, clean = (np.bincount(at, weights=counts * (labels == y), minlength=len(raw)) for y in (1, 0))
    errors = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    edges = np.concatenate([[raw[0] - 2], raw, [raw[-1] + 2]])
    least = np.flatnonzero(errors == errors.min())
    k = least[np.argmax(edges[least + 1] - edges[least])]
    return float((edges[k] + edges[k + 1]) / 2)


# -- learning: each step from rows (text, language or None, label, half, shard) to rows that are added up --

Row = tuple[str, str | None, int, int, int]
LEARNED = "text string, lang string, y int, half int, shard int"


def _ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    return word_buckets(words.distinct)[words.at], words.offsets


def tallies(rows: list[Row]) -> Iterator[tuple]:
    """(half, label or None, language, place, n): texts that hold a bucket, and after the buckets all; a language's tally and its texts."""
    texts = [r[0] for r in rows]
    flat, offsets = _ids(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    group = np.array([2 * half + y for _, _, y, half, _ in rows], np.int64)
    seen = np.unique(np.concatenate([owner * EVERY + flat[:, 0], owner * EVERY + flat[:, 1]]))
    n = np.bincount(group[seen // EVERY] * (EVERY + 1) + seen % EVERY, minlength=4 * (EVERY + 1)).reshape(4, EVERY + 1)
    n[:, EVERY] = np.bincount(group, minlength=4)
    for g, place in zip(*np.nonzero(n), strict=True):
        yield int(g) // 2, int(g) % 2, None, int(place), int(n[g, place])
    for lang in sorted({r[1] for r in rows if r[1] is not None}):
        own = [r[0] for r in rows if r[1] == lang]
        every = np.concatenate([*language_id.tally(own), [len(own)]])
        for place in np.flatnonzero(every):
            yield 0, None, lang, int(place), int(every[place])


def changes(rows: list[Row], starts: list[Network]) -> Iterator[tuple]:
    """(half, row of the parameters, its change in steps) of one shard's training."""
    half = rows[0][3]
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[2]))
    flat, offsets = _ids([r[0] for r in rows])
    net = starts[half].changed(np.zeros(1))
    train(net, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.array([r[2] for r in rows], np.int64))
    change = np.rint((net.table().astype(np.float64) - starts[half].table()) / CHANGE).astype(np.int64)
    dense = len(net.embedding)
    for k in np.flatnonzero(change.any(axis=1) | (np.arange(len(change)) >= dense)):
        yield half, int(k), *change[k].tolist()


def check_scores(rows: list[Row], nets: list[Network], buckets: Features, letters: Features) -> Iterator[tuple]:
    """(guessed language, label, raw score in steps, n): each text scored by the other half's network."""
    words = Words([r[0] for r in rows])
    ids = buckets.of(words.distinct)[words.at]
    half = np.array([r[3] for r in rows])
    raw = np.where(half == 0, nets[1].raw(ids, words.offsets), nets[0].raw(ids, words.offsets))
    steps = np.rint(np.clip(raw, -FAR, FAR) / STEP).astype(np.int64)
    guessed = language_id.label_texts(nets[0].languages, letters, words)[0]
    found: dict[tuple, int] = {}
    for lang, (_, _, y, _, _), step in zip(guessed, rows, steps.tolist(), strict=True):
        found[lang, y, step] = found.get((lang, y, step), 0) + 1
    for key, n in found.items():
        yield *key, n


def started(half: np.ndarray, y: np.ndarray, lang: list[str | None], place: np.ndarray, n: np.ndarray) -> tuple[list[Network], language_id.Model] | None:
    """Networks of each half and of all, untrained, and the language model, from added tallies; none without both labels."""
    counts, own = np.zeros((2, 2, EVERY + 1)), np.array([x is None for x in lang], bool)
    counts[half[own], y[own].astype(np.int64), place[own]] = n[own]
    every = counts.sum(axis=0)
    if not every[:, EVERY].all():
        return None
    found: dict[str, np.ndarray] = {}
    for k in np.flatnonzero(~own):
        found.setdefault(lang[k], np.zeros(language_id.BUCKETS + len(language_id.SCRIPT_NAMES) + 1))[place[k]] = n[k]
    languages = language_id.model_of({x: (int(v[-1]), v[: language_id.BUCKETS], v[language_id.BUCKETS : -1]) for x, v in found.items()})
    # a half without both labels tells nothing apart: its network learns from all
    parts = [c if c[:, EVERY].all() else every for c in counts]
    return [start(c[:, :EVERY], c[:, EVERY]) for c in (*parts, every)], languages


def trained(starts: list[Network], languages: language_id.Model, half: np.ndarray, row: np.ndarray, shards: np.ndarray, steps: np.ndarray) -> list[Network]:
    """Networks of each half and of all, from added changes: each row's mean over the shards that changed it."""
    size = len(starts[0].table())
    n, change = np.zeros((2, size, 1)), np.zeros((2, size, WIDTH))
    n[half, row, 0], change[half, row] = shards, steps * CHANGE
    nets = [s.changed(c / np.maximum(m, 1)) for s, c, m in zip(starts, (*change, change.sum(axis=0)), (*n, n.sum(axis=0)), strict=True)]
    for net in nets:
        net.languages = languages
    return nets


def with_thresholds(net: Network, found: Iterable[tuple[str | None, float]]) -> Network:
    net.raw_threshold = dict(found)
    return net


def threshold(lang: str | None, y: np.ndarray, step: np.ndarray, n: np.ndarray) -> Iterator[tuple[str | None, float]]:
    """A language's threshold, if it has ten texts of each label; that of all in any case."""
    if lang is None or min(n[y == 1].sum(), n[y == 0].sum()) >= 10:
        yield lang, best_threshold(step * STEP, y, n)


def fit(rows: list[tuple[str, str | None, int]]) -> Network | None:
    """From (text, language or None, label), all in this process."""
    if len({y for _, _, y in rows}) < 2:
        return None
    shards = -(-len(rows) // (2 * SHARD))
    dealt = [(t, lang, y, h % 2, h // 2 % shards) for t, lang, y in rows for h in [zlib.crc32(t.encode())]]
    half, y, lang, place, n = zip(*tallies(dealt), strict=True)
    starts, languages = started(np.array(half), np.array(y, float), list(lang), np.array(place), np.array(n))
    added: dict[tuple[int, int], np.ndarray] = {}
    for key in sorted({r[3:] for r in dealt}):
        for h, row, *steps in changes([r for r in dealt if r[3:] == key], starts):
            added[h, row] = added.get((h, row), 0) + np.array([1, *steps])
    at, sums = np.array(list(added)), np.array(list(added.values()))
    nets = trained(starts, languages, at[:, 0], at[:, 1], sums[:, 0], sums[:, 1:])
    lang, y, step, n = zip(*check_scores(dealt, nets, Features(word_buckets), Features(languages.features)), strict=True)
    guessed, y, step, n = np.array(lang), np.array(y), np.array(step), np.array(n)
    found = [*threshold(None, y, step, n)]
    for x in sorted(set(lang)):
        found += threshold(x, *(v[guessed == x] for v in (y, step, n)))
    return with_thresholds(nets[2], found)


def _rows(batch: pa.RecordBatch | pa.Table) -> list[Row]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "y", "half", "shard")), strict=True))


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


TALLY = pa.schema([("half", pa.int32()), ("y", pa.int32()), ("lang", pa.string()), ("place", pa.int32()), ("n", pa.int64())])
CHANGES = pa.schema([("half", pa.int32()), ("row", pa.int32()), *[(f"d{k}", pa.int64()) for k in range(WIDTH)]])
CHECKED = pa.schema([("lang", pa.string()), ("y", pa.int32()), ("step", pa.int64()), ("n", pa.int64())])
FOUND = pa.schema([("lang", pa.string()), ("edge", pa.float64())])


def fit_all(rows: DataFrame) -> Network | None:
    """From rows of ``LEARNED``, where they are; only sums of a fixed size, and a number a language, reach the driver."""
    spark = rows.sparkSession
    ddl = lambda schema: ", ".join(f"{f.name} {dict(int32='int', int64='long', double='double', string='string')[str(f.type)]}" for f in schema)

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(_text_sizes(batch.column(0)), 8 << 20):
                yield _batch(tallies(_rows(batch.slice(a, b - a))), TALLY)

    t = rows.mapInArrow(by_batch, ddl(TALLY)).groupBy("half", "y", "lang", "place").agg(F.sum("n").alias("n")).toArrow()
    column = lambda t, c: t.column(c).to_numpy()
    made = started(column(t, "half"), column(t, "y"), t.column("lang").to_pylist(), column(t, "place"), column(t, "n"))
    if made is None:
        return None
    starts, languages = made
    untrained = spark.sparkContext.broadcast(starts[:2])  # of a fixed size

    def by_shard(shard: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(changes(_rows(shard), untrained.value), CHANGES)])

    steps = [f"d{k}" for k in range(WIDTH)]
    changed = rows.groupBy("half", "shard").applyInArrow(by_shard, ddl(CHANGES))
    t = changed.groupBy("half", "row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in steps]).toArrow()
    nets = trained(starts, languages, column(t, "half"), column(t, "row"), column(t, "n"), np.stack([column(t, c) for c in steps], axis=1))
    halves = spark.sparkContext.broadcast(nets[:2])  # of a fixed size

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = halves.value
        buckets, letters = Features(word_buckets), Features(own[0].languages.features)
        for batch in batches:
            for a, b in chunks(_text_sizes(batch.column(0)), 2 << 20):
                yield _batch(check_scores(_rows(batch.slice(a, b - a)), own, buckets, letters), CHECKED)

    def by_language(found: pa.Table) -> pa.Table:
        lang = found.column("lang")[0].as_py()
        return pa.Table.from_batches([_batch(threshold(lang, *(column(found, c) for c in ("y", "step", "n"))), FOUND)])

    checked = rows.mapInArrow(by_text, ddl(CHECKED)).withColumn("lang", F.explode(F.array("lang", F.lit(None).cast("string"))))
    # a language has at most a row for each step and label
    edges = checked.groupBy("lang", "y", "step").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(by_language, ddl(FOUND))
    return with_thresholds(nets[2], [(r["lang"], r["edge"]) for r in edges.collect()])


_STORES: dict[int, tuple[Network, Features, Features]] = {}


def _kept(shared: Broadcast) -> tuple[Network, Features, Features]:
    """A worker's network and its stores of words, kept from task to task."""
    net = shared.value
    key = hash(net.out.tobytes())
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = net, Features(word_buckets), Features(net.languages.features)
    return _STORES[key]


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on)."""
    rows = docs.drop("score", "predicted")
    if net is None:
        return rows.withColumns({"score": F.lit(0.5), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets, letters = _kept(shared)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b in chunks(_text_sizes(batch.column(at)), 2 << 20):
                part = batch.slice(a, b - a)
                texts = part.column(at)
                words = Words(texts)
                ids = buckets.of(words.distinct)[words.at]
                raw = own.raw(ids, words.offsets)
                langs = language_id.label_texts(own.languages, letters, words)[0]
                edge = np.array([own.raw_threshold.get(x, own.raw_threshold[None]) for x in langs])
                made = 1 / (1 + np.exp(-np.clip(raw - edge + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64()), pa.array((made >= THRESHOLD).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled text, as ``LEARNED``; rows equal in id and text once."""
    ids = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    shards = -(-ids.count() // (2 * SHARD)) or 1
    full = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    once = full.join(small(ids), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("lang").alias("lang"), F.any_value("text").alias("text"))
    # equal texts share a half, but not a shard
    half = (F.crc32(F.col("text").cast("binary")) % 2).cast("int")
    return once.select("text", "lang", "y", half.alias("half"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)).cast("int").alias("shard"))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, str | None, int]]:
    """Every labelled text, language and label, as ``fit`` takes them; for tables that this process can hold."""
    return [(r["text"], r["lang"], r["y"]) for r in labelled(docs, labels).orderBy("text", "y", "lang").select("text", "lang", "y").collect()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    net = fit_all(cut(labelled(docs.where(~held), read_table(spark, sf_dir, "labels"))))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), net).drop("text")
