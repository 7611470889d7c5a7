import numpy as np
from pyspark.sql import functions as F

from weirflow.llm import toxicity
from weirflow.llm.common import least_of_each


def test_least_of_each_is_the_plain_top(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(g), int(v)) for g, v in zip(rng.choice(3, 3000, p=[0.9, 0.09, 0.01]), rng.integers(0, 1 << 40, 3000))})
    got = least_of_each(spark.createDataFrame(rows, "g int, v long"), "g", ["v"], 40).collect()
    want = [(g, v) for k in range(3) for g, v in [r for r in rows if r[0] == k][:40]]
    assert sorted(map(tuple, got)) == want
    assert least_of_each(spark.createDataFrame([], "g int, v long"), "g", ["v"], 40).isEmpty()


def test_repeated_rows_are_learned_once(spark):
    docs = spark.createDataFrame([(1, "a b", "x")] * 50 + [(2, "c d", None), (3, None, "x"), (4, "e", "y"), (4, "f", "y")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels)
    assert sorted(got, key=str) == [("a b", "x", 1), ("c d", None, 0), ("e", "y", 0), ("f", "y", 0)]
    assert toxicity.sample(docs.where(F.lit(False)), labels) == []
