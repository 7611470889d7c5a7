"""Small tables with nulls, empty texts, ties, repeated rows and clashing columns; results against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import bpe, language_id, line_dedup, nearest, ngram_join, quality_rules, source_mixing, token_counts, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(25)]
    out = [None, "", "  \n\t ", "one", "Two words", "<|endoftext|>", "a" * 3000, " ".join(["very"] * 2000), "é　中文 😀\r\n x\x1cy  "]
    for t in base:
        w = t.split(" ")
        out += [t, t, t.upper()]
        if len(w) > 30:
            w[3] = "changed"
            out += [" ".join(w), t + "\n" + t + "\n" + t.replace("a", "b", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-2:], SCHEMA).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(0)).cache()


def links(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def test_bpe_equals_the_library(spark, docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    got = {r["doc_id"]: r for r in bpe.digests(docs.select("doc_id", "text", "n_tokens")).collect()}
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.select("doc_id", "text").limit(0)).count() == 0


def test_bpe_on_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(7)
    parts = ["a", "aaaa", " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "中", "😀", "\x1c", "\x85", "\xa0", "<|endoftext|>", "1", "²", "_", "Ᲊ", "\U00010d40", "The", " the"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    ids, offsets = bpe.encoder().encode(some)
    for k, x in enumerate(some):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    assert bpe.encoder().decode(ids, offsets) == some
    wild = [[rng.randrange(50257) for _ in range(rng.randint(0, 20))] for _ in range(500)]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in wild])])
    assert bpe.encoder().decode(np.concatenate([np.array(w, np.int64) for w in wild]), ends) == [t.decode(w, skip_special_tokens=False) for w in wild]


def test_decode_column_with_nulls(spark):
    df = spark.createDataFrame([([262, 999999, -1],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df).collect()] == [" the", "", ""]


def test_token_counts(spark, docs, texts):
    lengths = [r["n_tokens"] for r in bpe.count(docs.select("text")).collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(bpe.count(docs.select("text"))), block=16).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for r in token_counts.at_limits(sums, [0, 5, 77, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["limit_tokens"]) for x in lengths)
        assert r["docs_over"] == sum(x > r["limit_tokens"] for x in lengths)
    assert token_counts.suffix_sums(token_counts.histogram(bpe.count(docs.limit(0)))).count() == 0


def test_mixing_draws_poisson_counts(spark, docs):
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, None).otherwise("a").alias("source"), F.lit("xxxx").alias("text"), F.lit("c").alias("copy"))
    out = Counter(r["doc_id"] for r in source_mixing.mix(big, power=0.0).select("doc_id").collect())
    for rest, mean, ids in ((True, 5.0, range(0, 20000, 10)), (False, 5 / 9, (k for k in range(20000) if k % 10))):
        n = np.array([out.get(k, 0) for k in ids])
        assert abs(n.mean() - mean) < 0.05 * mean + 0.02 and abs(n.var() - mean) < 0.1 * mean
    heavy = source_mixing.mix(big.withColumn("source", F.col("source")), weights={"a": 1.0})
    assert heavy.where("source IS NULL").count() == 0
    once = source_mixing.mix(docs).select("doc_id", "copy")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, source_mixing.mix(docs.repartition(3)).select("doc_id", "copy").collect()))
    assert source_mixing.mix(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com/en/9", "http://notexample.com/en/7", "ftp://x.org/es/", "http://x.org/es", None, "no url", "http://com/en/", "http://", "http://net/de/8", "http://example.net/de/8#f"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == ("org/es/", "block")
    assert got[4][2:] == (None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][3] == "block" and got[8][:2] == ("", "") and got[9][2] == "net/de/" and got[10][2] == "example.net/de/8"
    assert url_filters.judge(df, rules=[]).where("verdict <> 'allow'").count() == 0
    assert url_filters.judge(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(28, 70))) for _ in range(40)]
    lines = list(base)
    for b in base:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                k, o = rng.randrange(len(c)), rng.randrange(3)
                c[k : k + (o > 0)] = rng.choice("xyé") if o < 2 else ""
            lines.append("".join(c))
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 8)))) for k in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= line_dedup.SHORTEST and x.strip()})
    left, right = (spark.createDataFrame(list(enumerate(own)), f"{c} int, {c}x string") for c in "ab")
    near = [tuple(r) for r in left.join(right, F.expr("a < b AND levenshtein(ax, bx) <= 2")).select("a", "b").collect()]
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[find(a)] = find(b)
    first, want = {}, defaultdict(list)
    for k, t in rows:
        for j, x in enumerate((t or "").split("\n")):
            if x in own:
                c = find(own.index(x))
                if c in first:
                    want[k].append(j)
                first.setdefault(c, (k, j))
    got = {r["doc_id"]: r["removed"] for r in line_dedup.decisions(df).collect()}
    assert got == dict(want)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df.withColumn("removed", F.lit(1))).collect()}
    assert 60 in kept and 61 in kept and all(kept[k] == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want.get(k, [])) for k, t in rows if t and k in kept)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_edit_distance_bound(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choices("abé", k=rng.randint(0, 16)))
        b = "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "a", "éb"])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "x string, y string")
    for edits in (1, 2, 3):
        assert df.where(line_dedup.within(F.col("x"), F.col("y"), edits) != (F.levenshtein("x", "y") <= edits)).count() == 0


def test_quality_rules(spark, docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs.select("doc_id", "text", F.lit("clash").alias("kept"))).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) for j in range(3) if grams[tuple(w[i : i + 3])] > 1}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, k
        assert got[k]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (got[k]["kept"] and got[k]["base_failed"])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_ngram_join(spark, docs, texts):
    def shingles(t):
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    want = links(sets)
    got = {r["doc_id"]: r for r in ngram_join.join(docs.select("doc_id", "text")).collect()}
    assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    kept = ngram_join.stage(None, docs, "")
    assert kept.columns == docs.columns
    empty = {k for k, s in enumerate(sets) if not s}
    assert {r["doc_id"] for r in kept.collect()} == set(want) | empty
    assert ngram_join.join(docs.select("doc_id", "text").limit(0)).count() == 0


def test_ngram_join_of_small_sets_by_subsets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("pqrs", k=rng.randint(5, 12)))) for k in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, t in rows]
    assert [got[k] for k in range(300)] == links(sets)


def test_language_id(spark):
    rng = random.Random(2)
    vocab = {"en": ["the", "with", "thing", "would"], "de": ["der", "nicht", "schön", "über"], "ru": ["это", "слово", "когда"]}
    say = lambda lang, n: " ".join(rng.choices(vocab[lang], k=n))
    rows = [(say(lang, 20), lang) for lang in vocab for _ in range(20)]
    model = language_id.learn(rows)
    mixed = say("en", 12) + " " + say("de", 30) + " " + say("ru", 9)
    df = spark.createDataFrame([(0, say("de", 9), "x"), (1, None, "x"), (2, "123 !?", "x"), (3, mixed, "x"), (4, "", "x"), (5, "ελληνικά", "x")], "doc_id int, text string, score string")
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 3, 4)] == ["de", "und", "und", "de", "und"] and got[5]["lang_pred"] in vocab
    assert [(s["lang"], s["first"], s["last"]) for s in got[3]["spans"]] == [("en", 0, 11), ("de", 12, 41), ("ru", 42, 50)]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.learn([])
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    offsets = np.array([0, 7, 7, 12, 13])
    scores = rng.normal(0, 3, (13, 3)).astype(np.float32)
    got = language_id.viterbi(scores, offsets, 2.0)
    from itertools import product

    for a, b in zip(offsets[:-1], offsets[1:]):
        best = max((sum(scores[a + i, s] for i, s in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:])) for p in product(range(3), repeat=b - a)), default=0)
        own = got[a:b]
        assert abs(sum(scores[a + i, s] for i, s in enumerate(own)) - 2.0 * (own[1:] != own[:-1]).sum() - best) < 1e-4


def test_toxicity_finds_what_labels_mark(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["vile", "rotten", "scumlike"]

    def make(y):
        w = rng.choices(words, k=rng.randint(5, 120))
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(make(k % 2), "en", k % 2) for k in range(800)]
    net = toxicity.fit(rows[:600])
    df = spark.createDataFrame([(k, t, y) for k, (t, _, y) in enumerate(rows[600:])] + [(900, None, 0), (901, "", 0)], "doc_id int, text string, y int")
    got = toxicity.score(df, net).collect()
    assert sum(r["predicted"] == r["y"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in toxicity.score(df, toxicity.fit([("a", "en", 1)])).collect()} == {0.5}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (600, 10)), np.repeat(rng.normal(0, 1, (1, 10)), 200, axis=0)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 10), (1002, [float("nan")] * 10), (1003, [None] * 10), (1004, [1.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 800, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(800), d))[:10]
        hits += len(set(want.tolist()) & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-9 for i, s in got[q])
    assert set(got) == set(range(0, 800, 50)) and hits >= 0.9 * 160
    few = df.where("vec_id < 4")
    assert nearest.search(few, few).count() == 12
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0
