"""Language identification of mixed-language text.

A word's script, by ranges of code points, leaves only the languages that were
learned in that script; a learned table of hashed letter n-grams scores the word
in each of them.  A Viterbi pass over the words of a text, in which a change of
language costs a fixed penalty, labels its spans.  The text's language is the one
with the most letters in its spans; the score is its share of the letters times
the mean probability of its words' scores.

The table is learned in numpy from a bounded sample of labelled rows, at most
``SAMPLE`` of each language, smallest hash first.  Every language is learned;
beyond ``LANGUAGES`` of them each has fewer rows, so that all together stay at
LANGUAGES * SAMPLE or one a language, and texts are scored in smaller chunks.
The table has BUCKETS numbers a language.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and no spans; letters in a script that wasn't learned score alike in every
language, so the prior decides; ties go to the first language by name; repeated
rows are labelled alike; without any labelled row everything with a letter is
``und``; input columns with an output's name are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.bpe import CHUNK_BYTES, _text_sizes, chunks
from weirflow.llm.common import held_out, least_of_each, read_table
from weirflow.llm.words import CACHE_WORDS, Features, Words

#: Learning rows of each language at most.
SAMPLE = 400
#: Languages that are learned from ``SAMPLE`` rows each; more share as many rows.
LANGUAGES = 64
BUCKETS = 1 << 16
#: What a change of language costs, in nats.
PENALTY = 6.0
#: A script's languages are those with at least this share of their own words in it in learning.
SCRIPT_SHARE = 0.001
UND = "und"
#: Fixed ranges of code points, first match wins; letters elsewhere are "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = (*dict.fromkeys(s for s, _, _ in SCRIPTS), "other")

_EVERY = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
_PRIME = np.uint32(0x01000193)


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its script."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    for m in regex.compile(r"\p{L}+").finditer(_EVERY):
        a, b = ord(m[0][0]), ord(m[0][-1])  # no run crosses the surrogates
        letter[a : b + 1] = True
    kind = np.full(sys.maxunicode + 1, len(SCRIPT_NAMES) - 1, np.int8)
    for name, a, b in reversed(SCRIPTS):
        kind[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, kind


class Grams:
    """Letters of words and hashed n-grams of them, n from 1 to 3, and of the whole word."""

    def __init__(self, words: Sequence[str]):
        letter, kind = alphabet()
        flat = np.frombuffer("".join([w.lower() + " " for w in words]).encode("utf-32-le"), np.uint32)
        owner = np.cumsum(flat == 32) - (flat == 32)  # a word holds no space
        keep = letter[flat]
        flat, owner = flat[keep], owner[keep]
        self.letters = np.bincount(owner, minlength=len(words))
        self.rows = np.flatnonzero(self.letters)  # words with a letter
        size = self.letters[self.rows]
        starts = np.cumsum(size) - size
        self.script = kind[flat[starts]] if len(size) else np.empty(0, np.int8)
        # each word with a mark before and after it
        place = np.arange(len(flat)) + 2 * np.repeat(np.arange(len(size)), size) + 1
        marked = np.zeros(len(flat) + 2 * len(size), np.uint32)
        marked[place] = flat
        word = np.repeat(np.arange(len(size)), size + 2)
        with np.errstate(over="ignore"):
            c = (marked + np.uint32(1)) * np.uint32(2654435761)
            two = (c[:-1] * _PRIME) ^ (c[1:] + np.uint32(77))
            three = (two[:-1] * _PRIME) ^ (c[2:] + np.uint32(191))
            far = np.arange(len(marked)) - np.repeat(np.cumsum(size + 2) - size - 2, size + 2)
            whole = np.add.reduceat(c * (np.uint32(2) * far.astype(np.uint32) + np.uint32(3)) ** 2, starts + 2 * np.arange(len(size))) if len(size) else c
            groups = [(c[place], word[place]), (two[word[:-1] == word[1:]], word[:-1][word[:-1] == word[1:]]), (three[word[:-2] == word[2:]], word[:-2][word[:-2] == word[2:]]), (whole, np.arange(len(size)))]
            #: (bucket, place in ``rows``) of n-grams of each kind, words in order
            self.groups = [(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k) >> np.uint32(13)).astype(np.int64) % BUCKETS, w) for k, (h, w) in enumerate(groups)]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word with a letter the sum of its n-grams' rows over the root of their number."""
        total = np.zeros((len(self.rows), table.shape[1]), np.float32)
        n = np.zeros(len(self.rows))
        for bucket, word in self.groups:
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                total[word[first]] += np.add.reduceat(table[bucket], first, axis=0)
                n += np.bincount(word, minlength=len(n))
        return total / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log probabilities
    scripts: np.ndarray  # scripts x languages, 0 or minus infinity
    prior: np.ndarray

    def fitting(self, most: int) -> int:
        """``most`` rows or bytes, fewer by the languages beyond LANGUAGES, as each row has a score a language."""
        return max(1, most * LANGUAGES // max(len(self.languages), LANGUAGES))

    def features(self, words: list[str]) -> np.ndarray:
        """For each word: its letters, then its score in each language, 0 for the best."""
        out = np.zeros((len(words), 1 + len(self.languages)), np.float32)
        grams = Grams(words)
        if len(grams.rows):
            out[:, 0] = grams.letters
            allowed = self.scripts[grams.script]
            known = (allowed == 0).any(axis=1)
            score = np.where(known[:, None], grams.sums(self.table) + allowed, self.prior[None, :])
            out[grams.rows, 1:] = np.maximum(score - score.max(axis=1, keepdims=True), -30.0)
        return out


def tally(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram's bucket, and how often each script, occurs in some texts."""
    counts, scripts = np.zeros(BUCKETS), np.zeros(len(SCRIPT_NAMES))
    for a, b in chunks([len(t) for t in texts]):
        words = Words(texts[a:b])
        grams = Grams(words.distinct)
        seen = np.bincount(words.at, minlength=len(words.distinct))[grams.rows]
        for bucket, word in grams.groups:
            counts += np.bincount(bucket, weights=seen[word], minlength=BUCKETS)
        scripts += np.bincount(grams.script, weights=seen, minlength=len(SCRIPT_NAMES))
    return counts, scripts


def model_of(found: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """From each language's number of texts and their tally."""
    languages = sorted(found)
    table = np.empty((BUCKETS, len(languages)), np.float32)
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    prior = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        prior[k], counts, scripts[:, k] = found[lang]
        table[:, k] = np.log((counts + 0.1) / (counts.sum() + 0.1 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(languages, table, np.where(share >= SCRIPT_SHARE, 0.0, -np.inf).astype(np.float32), np.log(np.maximum(prior, 1) / max(prior.sum(), 1)).astype(np.float32))


def learn(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) pairs."""
    texts_of: dict[str, list[str]] = {}
    for t, lang in rows:
        texts_of.setdefault(lang, []).append(t)
    return model_of({lang: (len(texts), *tally(texts)) for lang, texts in texts_of.items()})


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns every language from at most ``sample`` different texts of it.

    Only hashes are sorted; the texts of those picked are fetched by a broadcast
    of the picks, at most LANGUAGES * ``sample`` rows or one a language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    languages = labelled.select("l").distinct().count()
    each = max(1, sample * LANGUAGES // max(languages, LANGUAGES))
    picks = least_of_each(labelled.select("l", "h").distinct(), "l", ["h"], each)
    rows = labelled.join(F.broadcast(picks), ["l", "h"]).dropDuplicates(["l", "h"])
    return learn([(r["t"], r["l"]) for r in rows.orderBy("l", "h").select("t", "l").collect()])


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word, for texts that lie one after another.

    All texts advance together, word by word; the longest come first, so those
    that still have a word are always the first ones.
    """
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][order], size[order]
    langs = scores.shape[1]
    kind = np.min_scalar_type(max(langs - 1, 0))
    label = np.zeros(len(scores), kind)
    if not len(scores) or langs < 2:
        return label
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    best = scores[start[: alive[0]]].copy()
    switch = np.empty(scores.shape, bool)  # whether the word's language was entered by a change
    origin = np.empty(len(scores), kind)  # the best language of the word before
    rows = np.arange(alive[0])
    for t in range(1, size[0]):
        n = alive[t]
        at, own = start[:n] + t, best[:n]
        top = own.argmax(axis=1)
        change = own[rows[:n], top][:, None] - penalty
        switch[at] = change > own
        origin[at] = top
        np.maximum(own, change, out=own)
        own += scores[at]
    now = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = np.where(switch[at, now[:n]], origin[at], now[:n])
    return label


_STORES: dict[int, tuple[Model, Features]] = {}


def _kept(shared: Broadcast) -> tuple[Model, Features]:
    """A worker's model and its store of scored words, kept from task to task."""
    key = hash((shared.value.table[:512].tobytes(), tuple(shared.value.languages)))
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = shared.value, Features(shared.value.features, shared.value.fitting(CACHE_WORDS))
    return _STORES[key]


SPAN = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
OUTPUTS = (T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPAN))


def label_texts(model: Model, store: Features, texts: pa.Array | Words) -> tuple[list[str], np.ndarray, np.ndarray, Words]:
    """Language and score of each text, and the language of each word."""
    words = texts if isinstance(texts, Words) else Words(texts)
    n, langs = len(words), len(model.languages)
    if not langs or not len(words.at):
        return [UND] * n, np.zeros(n), np.zeros(len(words.at), np.int8), words
    rows = store.of(words.distinct)[words.at]
    letters, scores = rows[:, 0], rows[:, 1:]
    label = viterbi(scores, words.offsets)
    odds = np.exp(scores)
    sure = odds[np.arange(len(rows)), label] / odds.sum(axis=1)
    owner = np.repeat(np.arange(n), np.diff(words.offsets))
    by = np.bincount(owner * langs + label, weights=letters, minlength=n * langs).reshape(n, langs)
    sure_by = np.bincount(owner * langs + label, weights=letters * sure, minlength=n * langs).reshape(n, langs)
    total, top = by.sum(axis=1), by.argmax(axis=1)
    some = total > 0
    score = np.where(some, sure_by[np.arange(n), top] / np.maximum(total, 1), 0.0)
    return [model.languages[k] if s else UND for k, s in zip(top, some, strict=True)], np.clip(score, 0, 1), label, words


def spans_of(model: Model, label: np.ndarray, words: Words) -> pa.Array:
    """Runs of one language in each text, as places of their first and last words."""
    owner = np.repeat(np.arange(len(words)), np.diff(words.offsets))
    begins = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])])) if len(label) else np.empty(0, np.int64)
    ends = np.append(begins[1:], len(label)) - 1 if len(begins) else begins
    base = words.offsets[owner[begins]]
    names = pa.array([model.languages[k] for k in label[begins]] if model.languages else [UND] * len(begins), pa.string())
    flat = pa.StructArray.from_arrays([names, pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["lang", "first", "last"])
    per = np.bincount(owner[begins], minlength=len(words)) if len(begins) else np.zeros(len(words), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), flat)


def predict(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and, if asked for, the ``spans`` of its text."""
    new = OUTPUTS[: 3 if spans else 2]
    rows = docs.drop(*[f.name for f in new])
    schema = T.StructType([*rows.schema.fields, *new])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, store = _kept(shared)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b in chunks(_text_sizes(batch.column(at)), own.fitting(CHUNK_BYTES)):
                part = batch.slice(a, b - a)
                lang, score, label, words = label_texts(own, store, part.column(at))
                made = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    made.append(spans_of(own, label, words))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *[f.name for f in new]])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
