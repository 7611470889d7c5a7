"""Byte-level BPE: encoding and decoding in batched numpy merge rounds.

Encoding.  A text is cut at special tokens, the pieces at the vocabulary's
pattern, and the distinct words that a worker hasn't met are merged together:
the byte symbols of all of them lie in one flat array; each round looks up the
rank of every neighbouring pair by binary search over the sorted pair keys,
takes each word's lowest rank, merges its places from left to right and packs
the array again.  A word leaves when no pair of it has a rank.

Decoding.  Token bytes lie in one flat array with offsets; a batch of id lists
is one gather over it.  Bytes that aren't UTF-8 become replacement characters.

Defined results: a null text counts as empty and an empty text has no ids; null
ids decode to an empty text, unknown ids to nothing; repeated rows are encoded
alike; an input column with the name of the output is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import read_table

VOCABULARY = "byte_bpe_50k.json"
#: Distinct stretches between spaces whose ids a worker keeps; then it starts anew.
CACHE_UNITS = 400_000
#: Bytes of text (or of ids) that are worked on at once; one longer text goes alone.
CHUNK_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


#: A space beside another blank, by the widest notion of a blank.
_BLANK = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BLANKS = f"{_BLANK} | {_BLANK}"


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat`` one after another, and their offsets."""
    size = size[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], size)], ends


@lru_cache(maxsize=1)
def young_ranges() -> list[tuple[int, int]]:
    """Letters and digits of newer Unicode tables than the tokenizer library's, to which they are neither.

    Only what Python's own tables don't assign can be; the library is asked about that.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]").match
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn" and known(chr(c)) and all(len(split(x + chr(c))) > 1 for x in "a1"):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return [(a, b) for a, b in out]


class Encoder:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(pattern).findall
        young = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in young_ranges())
        self.young = re.compile(f"[{young}]").search if young else (lambda text: None)
        old = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{young}])")
        for kind in (r"\p{L}", r"\p{N}"):
            old = re.sub(rf"(?<!\\s)(?<!\\p{{L}}){re.escape(kind)}", lambda m: f"(?:(?![{young}]){m[0]})", old)
        self.old_words = regex.compile(old).findall
        self.byte_id = np.full(256, -1, np.int32)
        for c, b in alphabet.items():
            if c in vocab:
                self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        keys = left << 32 | right
        self.none = len(merges)
        order = np.argsort(keys, kind="stable")
        self.keys = np.concatenate([keys[order], [np.iinfo(np.int64).max]])
        self.ranks = np.concatenate([order, [0]]).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        parts = [b""] * size
        for t, i in vocab.items():
            parts[i] = bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            parts[i] = t.encode()
        self.token_len = np.array([len(p) for p in parts], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.forget()

    # -- encoding

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; ``none`` for a pair that doesn't merge."""
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], self.none)

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after another, and the number of ids of each."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        none, done = self.none, []
        if len(ids):
            rank = np.full(len(ids), none, np.int32)  # of the pair that starts here
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            if (lowest == none).any():
                over = np.repeat(lowest == none, sizes)
                done.append((owner[over], ids[over]))
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                sizes, lowest = sizes[lowest != none], lowest[lowest != none]
                if not len(ids):
                    break
            places = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # of places that overlap in a run (as in "aaa") every second one merges, from the left
            fresh = np.concatenate([[True], np.diff(places) != 1])
            if not fresh.all():
                first = places[fresh][np.cumsum(fresh) - 1]
                places = places[(places - first) % 2 == 0]
            ids[places] = self.made[rank[places]]
            stay = np.ones(len(ids), bool)
            stay[places + 1] = False
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            places = places - np.arange(len(places))  # where they are now
            # only the pairs on both sides of a merged place have changed
            inside = np.append(owner[1:] == owner[:-1], False)
            rank[places[~inside[places]]] = none
            changed = np.zeros(len(ids), bool)
            changed[places] = True
            changed[places[places > 0] - 1] = True
            new = np.flatnonzero(changed & inside)
            rank[new] = self.ranks_of(ids[new], ids[new + 1])
        owner, ids = (np.concatenate([d[k] for d in done]) if done else np.empty(0, np.int32) for k in (0, 1))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words)).astype(np.int64)

    def cut(self, text: str) -> list[str]:
        """The text's words; a special token is a word of its own."""
        words = self.words
        if not text.isascii() and self.young(text):
            words = self.old_words
        if not any(s in text for s in self.special):
            return words(text)
        out: list[str] = []
        for piece in self.split_special.split(text):
            out += [piece] if piece in self.special else words(piece)
        return out

    def forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {}
        self.flat, self.size, self.start = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, new: Sequence[str | tuple[str]]) -> None:
        """Adds the ids of new units to the store."""
        plain, whole = [u for u in new if isinstance(u, str)], [u for u in new if isinstance(u, tuple)]
        new = plain + whole
        cut = self.cut("".join([" " + u for u in plain]))  # they neither begin nor end with a blank
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        counts = np.diff(np.searchsorted(ends, np.cumsum([len(u) + 1 for u in plain], dtype=np.int64)) + 1, prepend=0).tolist()
        for u in whole:
            own = self.cut(u[0])
            cut += own
            counts.append(len(own))
        words = list(dict.fromkeys(cut))
        plain = [w for w in words if w not in self.special]
        flat, size = self.merge(plain)
        flat = np.concatenate([flat, np.fromiter(self.special.values(), np.int32, len(self.special))])
        size = np.concatenate([size, np.ones(len(self.special), np.int64)])
        place = dict(zip([*plain, *self.special], range(len(size)), strict=True))
        flat, offsets = _gather(flat, np.cumsum(size) - size, size, np.fromiter(map(place.__getitem__, cut), np.int64, len(cut)))
        offsets = offsets[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + offsets[:-1]])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, np.diff(offsets)])

    def encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and the offsets at which each begins (and the end).

        Words never run from a visible character into a space.  So a text with no
        space beside another blank is cut before every space, and each distinct
        stretch is looked up once a chunk; its first has no space before it.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(self.known) > CACHE_UNITS or len(self.flat) > 8 * CACHE_UNITS:
            self.forget()
        odd = pc.match_substring_regex(texts, _BLANKS)
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        first = flat.take(pa.array(offsets[:-1])).cast(texts.type)
        firsts = [(t,) for t in pc.if_else(odd, texts, first).to_pylist()]
        inner = [(" " + u,) if u[-1:].isspace() else u for u in flat.dictionary.to_pylist()]
        new = list(dict.fromkeys(u for u in chain(inner, firsts) if u not in self.known))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, inner), np.int64, len(inner))[flat.indices.to_numpy()]
        at[offsets[:-1]] = np.fromiter(map(self.known.__getitem__, firsts), np.int64, len(firsts))
        ids, ends = _gather(self.flat, self.start, self.size, at)
        return ids, ends[offsets]

    # -- decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists that lie one after another, list k from ``offsets[k]`` on."""
        fits = (ids >= 0) & (ids < len(self.token_len))
        ids = np.where(fits, ids, 0)
        lengths = np.where(fits, self.token_len[ids], 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(ends[-1]) + np.repeat(self.token_at[ids] - ends[:-1], lengths)
        raw = self.token_bytes[source].tobytes()
        at = ends[offsets]
        return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """A worker's encoder; without a path the public vocabulary's."""
    import public_tokenizers

    return Encoder(path or vocabulary_path(), public_tokenizers.PATTERN)


def chunks(sizes: Sequence[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; each has a row at least."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _added(df: DataFrame, column: str, out: str, kind: T.DataType, make: Callable[[pa.Array], pa.Array], size: Callable[[pa.Array], Sequence[int]]) -> DataFrame:
    """``df`` with a column made from another one chunk by chunk."""
    rows = df.drop(out) if out != column else df
    schema = T.StructType([f for f in rows.schema.fields if f.name != out] + [T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for a, b in chunks(size(batch.column(at))):
                part = batch.slice(a, b - a)
                kept = [(n, part.column(k)) for k, n in enumerate(part.schema.names) if n != out]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [make(part.column(at))], [n for n, _ in kept] + [out])

    return rows.mapInArrow(run, schema)


def _text_sizes(col: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(col), 0).to_pylist()


def _list_sizes(col: pa.Array) -> list[int]:
    return [4 * n for n in pc.fill_null(pc.list_value_length(col), 0).to_pylist()]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with its text's token ids (array<int>)."""

    def make(col: pa.Array) -> pa.Array:
        ids, offsets = encoder(path).encode(col)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return _added(df, text, out, T.ArrayType(T.IntegerType(), False), make, _text_sizes)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Every row with the text of its ids."""

    def make(col: pa.Array) -> pa.Array:
        col = pa.array(col.to_pylist(), col.type) if col.null_count else col
        offsets = col.offsets.to_numpy().astype(np.int64)
        flat = col.values.slice(offsets[0], offsets[-1] - offsets[0])
        flat = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(encoder(path).decode(flat, offsets - offsets[0]), pa.string())

    return _added(df, ids, out, T.StringType(), make, _list_sizes)


def count(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Every row with its number of tokens (long); the ids stay in the worker."""

    def make(col: pa.Array) -> pa.Array:
        return pa.array(np.diff(encoder(path).encode(col)[1]), pa.int64())

    return _added(df, text, out, T.LongType(), make, _text_sizes)


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row in place of its text."""
    coded = decode(encode(docs, text, "__ids", path).drop(text), "__ids", "__decoded", path)
    listed = F.array_join(F.col("__ids").cast("array<string>"), ",")
    made = {"n_tokens": F.size("__ids").cast("long"), "ids_sha256": F.sha2(listed, 256), "decoded_sha256": F.sha2(F.col("__decoded"), 256)}
    return coded.withColumns(made).drop("__ids", "__decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: documents with their ids, and the number of them, in place of their text."""
    return encode(docs, "text", "ids").drop("text").withColumn("n_tokens", F.size("ids").cast("long"))
