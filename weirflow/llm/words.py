"""Texts as arrays of word numbers, looked up once for each distinct word of a chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words whose features a worker keeps; then it starts anew.
CACHE_WORDS = 300_000


class Words:
    """Distinct words of some texts, the number of each word in order, and each text's offsets."""

    def __init__(self, texts: Sequence[str | None] | pa.Array):
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.values.slice(offsets[0], offsets[-1] - offsets[0])
        full = pc.not_equal(flat, "")
        flat = flat.filter(full).dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        self.offsets = ends[offsets - offsets[0]]
        self.distinct: list[str] = flat.dictionary.to_pylist()
        self.at = flat.indices.to_numpy()

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Features:
    """A store of one feature row a word, made for words not met before."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], most: int = CACHE_WORDS):
        self.make, self.most, self.known, self.rows = make, most, {}, None

    def of(self, words: Sequence[str]) -> np.ndarray:
        """A row for each of the words."""
        if len(self.known) > self.most:
            self.known, self.rows = {}, None
        new = [w for w in words if w not in self.known]
        if new:
            rows = self.make(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = rows if self.rows is None else np.concatenate([self.rows, rows])
        if self.rows is None:
            return self.make([])
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
