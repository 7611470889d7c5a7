import random

from weirflow.llm import common
from weirflow.llm.components import components


def test_long_chains_reach_one_label(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1 << 40), 1300)
    chain, other = ids[:1200], ids[1200:]
    edges = [*zip(chain, chain[1:]), *zip(other, other[1:]), *zip(other, other[2:])]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == dict.fromkeys(chain, min(chain)) | dict.fromkeys(other, min(other))
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).isEmpty()


def test_few_edges_take_no_rounds_and_many_give_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(700)]
    edges = [*zip(ids[:400], ids[1:401]), *[(rng.choice(ids[400:]), rng.choice(ids[400:])) for _ in range(150)], (ids[0], ids[0])]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr("weirflow.llm.common.shared_folder", lambda s: str(tmp_path))
    assert sorted(map(tuple, components(df.unionAll(df)).collect())) == want
    assert len(list(tmp_path.glob("weirflow-*"))) == 2
    monkeypatch.setattr("weirflow.llm.components.DRIVER_EDGES", 10)
    assert sorted(map(tuple, components(df).collect())) == want


def test_the_driver_collects_its_garbage_every_few_tables(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr("weirflow.llm.common.shared_folder", lambda s: str(tmp_path))
    monkeypatch.setattr("weirflow.llm.common.collected", lambda s: calls.append(s))
    for _ in range(2 * common.TABLES_A_COLLECTION):
        common.cut(spark.range(1))
    assert len(calls) == 2
