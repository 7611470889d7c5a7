import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import toxicity


def rows_of(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        w = rng.choices(words, k=rng.randint(5, 40)) + ["vile"] * (k % 4 == 0)
        rows.append((k, " ".join(rng.sample(w, len(w))), "en" if k % 3 else None, int(k % 4 == 0)))
    return rows


def frames(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return df.drop("toxic"), df.select("doc_id", "toxic")


def test_every_labelled_text_is_learned_from(spark):
    rows = [(k, f"text {k}", "en", 0) for k in range(2600)] + [(k, f"vile {k}", "en", 1) for k in range(2600, 2700)] + [(2700, "vile " * 14_000, "en", 1)]
    assert len(toxicity.sample(*frames(spark, rows))) == 2701
    words = toxicity.labelled(*frames(spark, rows)).select("half", "y", "text").collect()
    counts = {}
    for half, y, lang, place, n in toxicity.tallies([(r["text"], "en", r["y"], r["half"], 0) for r in words]):
        if lang is None and place == toxicity.EVERY:
            counts[y] = counts.get(y, 0) + n
    assert counts == {0: 2600, 1: 101}


def test_both_ways_to_learn_give_one_network(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 60)
    docs, labels = frames(spark, rows_of(400))
    rows = toxicity.labelled(docs, labels)
    assert rows.select("half", "shard").distinct().count() == 8
    net = toxicity.fit_all(rows.repartition(5))
    again = toxicity.fit_all(rows.repartition(2))
    assert all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters())) and set(net.raw_threshold) == {None, "en"}
    local = toxicity.fit(toxicity.sample(docs, labels))
    assert np.array_equal(local.languages.table, net.languages.table)
    test = spark.createDataFrame([(t, y) for _, t, _, y in rows_of(200, seed=6)], "text string, y int")
    for n in (net, local):
        assert toxicity.score(test.select("text", "y"), n).where("predicted = y").count() > 120
    assert toxicity.fit_all(rows.where("y = 1")) is None and toxicity.fit_all(rows.where(F.lit(False))) is None


def test_an_id_with_both_labels_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (1, "a", "de")], "doc_id long, text string, lang string")
    for order in ((0, 1), (1, 0)):
        labels = spark.createDataFrame([(1, y) for y in order], "doc_id long, toxic int")
        assert toxicity.sample(docs, labels) == [("a", "de", 1)]


@pytest.mark.parametrize("seed", range(5))
def test_threshold_has_the_fewest_errors(seed):
    rng = np.random.default_rng(seed)
    raw, y, n = rng.integers(-5, 6, 30) / 2.0, rng.integers(0, 2, 30), rng.integers(1, 9, 30)
    errors = lambda edge: int((n * ((raw >= edge) != y)).sum())
    edge = toxicity.best_threshold(raw, y, n)
    assert edge not in raw and errors(edge) == min(map(errors, np.arange(-8, 8, 0.25) + 0.1))


def test_a_text_is_checked_by_the_other_half():
    rows = [(t, None, y, half, 0) for t, y, half in [("vile a", 1, 0), ("b c", 0, 0), ("vile d", 1, 1), ("e f", 0, 1)] for _ in range(9)]
    own = [r for r in rows if r[3] == 0]
    half, y, lang, place, n = zip(*toxicity.tallies(rows))
    starts, _ = toxicity.started(np.array(half), np.array(y, float), list(lang), np.array(place), np.array(n))
    half, y, lang, place, n = zip(*toxicity.tallies(own))
    alone, _ = toxicity.started(np.array(half), np.array(y, float), list(lang), np.array(place), np.array(n))
    assert np.array_equal(starts[0].embedding, alone[0].embedding) and not np.array_equal(starts[0].embedding, starts[2].embedding)
    moved = starts[0].changed(np.ones_like(starts[0].table()))
    assert all(np.allclose(a + 1, b) for a, b in zip(starts[0].parameters(), moved.parameters()))
