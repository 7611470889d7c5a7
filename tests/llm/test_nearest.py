import numpy as np

from weirflow.llm import nearest


def rows_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, df.where("vec_id % 100 = 0"), **options).orderBy("query_id", "rank").collect()
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got]


def test_ties_go_to_the_smaller_id(spark):
    axes = np.eye(120)[np.random.default_rng(2).permutation(120)]
    got = rows_of(spark, [(0, [0.5] * 120)] + [(k + 1, v.tolist()) for k, v in enumerate(axes)], probes=100)
    assert [v for q, _, v, _ in got if q == 0] == list(range(1, 11))


def test_many_blocks_a_list(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 6))
    got = rows_of(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    hits = 0
    for q in range(0, 400, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {v for a, _, v, _ in got if a == q})
    assert len(got) == 40 and hits >= 36


def test_an_id_with_several_vectors_counts_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [5.0, 5.0])]
    got = rows_of(spark, rows)
    assert [(a, r, v) for a, r, v, _ in got] == [(0, 1, 2), (0, 2, 3)] and abs(got[0][3] - 0.1) < 1e-12
