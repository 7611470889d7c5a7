"""The bounds that the n-gram join puts before its exact test."""

from __future__ import annotations

import numpy as np
import pytest

from weirflow.llm import ngram_join as op

RANDOM = np.random.default_rng(7)


def pair(common: int, only_a: int, only_b: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.unique(RANDOM.integers(0, 1 << 64, common + only_a + only_b, np.uint64))
    RANDOM.shuffle(every)
    return np.sort(every[: common + only_a]), np.sort(np.concatenate([every[:common], every[common + only_a :]]))


@pytest.mark.parametrize("common", [600, 1023, 1024, 5000, 40000])
def test_wide_bitmaps_keep_every_linked_pair(common):
    for only in range(0, common // 3 + 1, max(common // 30, 1)):
        a, b = pair(common, only, common // 3 - only)
        assert 100 * common >= op.PERCENT * (common + common // 3)
        assert op.wide_may_link(op.wide_bitmap(a), op.wide_bitmap(b), len(a) + len(b))


def test_wide_bitmaps_turn_far_pairs_down():
    a, b = pair(2000, 2000, 3000)
    assert not op.wide_may_link(op.wide_bitmap(a), op.wide_bitmap(b), len(a) + len(b))


def test_small_sets_have_no_wide_bitmap():
    assert op.wide_bitmap(np.empty(0, np.uint64)) is None
    assert op.wide_bitmap(np.arange(op.BITMAP // 2, dtype=np.uint64)) is None
    assert len(op.wide_bitmap(np.arange(op.BITMAP // 2 + 1, dtype=np.uint64))) * 8 == 2 * op.BITMAP


def test_no_rounds_when_no_list_is_parted(spark, monkeypatch):
    calls, verified = [], op.verified
    monkeypatch.setattr(op, "verified", lambda *a: (calls.append(1), verified(*a))[1])
    words = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(k, " ".join([*words, *"abcdefgh"[:k]])) for k in range(8)], "doc_id long, text string")
    assert {r["component_id"] for r in op.join(docs).collect()} == {0}
    assert len(calls) == 1
