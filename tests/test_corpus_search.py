import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import corpus, search
from quillstone.operators.resilient import resilient_map


def test_support_and_ranks(spark):
    df = spark.createDataFrame([(1, "a", "t", 2), (2, "b", "u", None), (3, "a", "t", 1), (4, "c", None, 9), (5, "d", "v", 3)], "seq int, code string, tpl string, w int")
    got = {r.code: (r.support, r.seq) for r in corpus.support(df, "code", "seq").collect()}
    assert got == {"a": (2, 3), "b": (1, 2), "c": (1, 4), "d": (1, 5)}
    assert [(r.tpl, r.support) for r in corpus.group_support(df, "tpl", "w", "seq").orderBy("place").collect()] == [("t", 3), ("v", 3), ("u", 0)]
    kept = {r.code: (r.seq, r.first_seq) for r in corpus.keep_last(df, "code", "seq").collect()}
    assert kept["a"] == (3, 1)
    assert {r.seq for r in corpus.collapse(df, F.col("tpl") == "t", "seq").collect()} == {1, 2, 4, 5}
    assert corpus.collapse(df.limit(0), F.col("tpl") == "t", "seq").collect() == []


def test_scheduling(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 3), ("b", 1)) for i in range(n)], "g string, i int")
    assert sorted((r.g, r.i, r["round"]) for r in corpus.round_robin(df, "g", "g", ["i"]).collect()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 0, 0)]
    assert sorted((r.g, r["round"], r.i) for r in corpus.cyclic_rounds(df, "g", ["i"], 4).collect()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, 0)] + [("b", k, 0) for k in range(4)]
    s = spark.range(100)
    a, b = corpus.shuffled(s, "id", 1), corpus.shuffled(s, "id", 1, 10, 5)
    order = [r.id for r in a.orderBy("place").collect()]
    assert sorted(order) == list(range(100)) and order != list(range(100)) and [r.id for r in b.orderBy("place").collect()] == order[10:15]
    assert {r.chunk: r["count"] for r in corpus.chunked(s, ["id"], 30).groupBy("chunk").count().collect()} == {0: 30, 1: 30, 2: 30, 3: 10}
    part = {r.id: r.part for r in corpus.split(s, "id", 0.8).collect()}
    assert part == {r.id: r.part for r in corpus.split(s.filter("id < 50"), "id", 0.8).union(corpus.split(s.filter("id >= 50"), "id", 0.8)).collect()}


def test_pairs(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, i int")
    got = sorted((r.g, r.a, r.b) for r in corpus.pairs_within(df, "g", "i", 2).collect())
    assert got == sorted((a % 3, a, a + 3 * k) for a in range(30) for k in (1, 2) if a + 3 * k < 30)
    neg = corpus.negatives(df, "g", "i", 3).collect()
    assert len(neg) == 90 and all(r.i % 3 != r.other % 3 for r in neg) and len({(r.i, r.turn) for r in neg}) == len({(r.i, r.other) for r in neg}) == 90
    skewed = spark.createDataFrame([(0 if i < 20 else i, i) for i in range(24)] + [(None, 99)], "g int, i int")  # one group holds most rows
    neg = corpus.negatives(skewed, "g", "i", 6).collect()
    per = {i: sum(r.i == i for r in neg) for i in range(24)}
    assert all(per[i] == (4 if i < 20 else 6) for i in per) and len({(r.i, r.other) for r in neg}) == len(neg)
    assert corpus.negatives(df.limit(0), "g", "i", 3).collect() == []


def test_merge_campaigns_raises_on_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert corpus.merge_campaigns([a, a.withColumn("k", F.lit(2))], "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        corpus.merge_campaigns([a, a], "k").collect()


def test_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None)], "i int, h array<string>")
    assert [r.i for r in df.filter(corpus.all_of([corpus.uses_all(F.col("h"), ["a"]), corpus.uses_none(F.col("h"), ["c"])])).collect()] == [1]
    assert df.filter(corpus.all_of([])).count() == 3


def _vectors(spark, n=300, dim=8, seed=1):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v[5] = v[9]
    v[7] = 0
    return v, spark.createDataFrame([(i, [float(x) for x in a], "e") for i, a in enumerate(v)] + [(n, None, "e")], "vec_id long, embedding array<float>, rank string").repartition(4)


def test_top_k_equals_brute_force(spark, monkeypatch):
    v, df = _vectors(spark)
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    q = df.filter("vec_id % 50 = 0 or vec_id in (5, 7)")
    got = {}
    for r in search.top_k(q, df, "vec_id", "embedding", 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    w = np.float32(v).astype(float)
    n = np.linalg.norm(w, axis=1)
    for i in (0, 5, 50, 250):
        s = np.round((w @ w[i]) / np.where(n > 0, n * n[i], 1), 12)
        want = sorted((k for k in range(300) if k != i and n[k] > 0), key=lambda k: (-s[k], k))[:6]
        assert got[i] == want
    assert 7 not in got
    assert search.top_k(q.limit(0), df, "vec_id", "embedding", 3).collect() == []


def test_indexed_search_recall(spark, capsys):
    from pathlib import Path

    d = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not d.exists():
        pytest.skip("no test data")
    v = spark.read.parquet(str(d)).select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want = pairs(search.top_k(q, v, "vec_id", "embedding", 10))
    got = pairs(search.approximate_top_k(q, v, "vec_id", "embedding", 10))
    compared = len(pairs(search.candidates(q, search.sign_codes(v, "vec_id", "embedding"), "vec_id", "embedding", 10)))
    recall, share = len(want & got) / len(want), compared / (q.count() * (v.count() - 1))
    with capsys.disabled():
        print(f" recall {recall:.3f} at {share:.3f} of all pairs", end="")
    assert recall >= 0.9 and share < 0.1


def test_search_in_small_blocks(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = sorted((x.query_id, x.vec_id, x.rank) for x in search.top_k(v, v, "vec_id", "embedding", 4).collect())
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 8 * 7)
    monkeypatch.setattr(search, "CELLS", 50)
    assert sorted((x.query_id, x.vec_id, x.rank) for x in search.top_k(v, v, "vec_id", "embedding", 4).collect()) == whole and len(whole) == 240
    assert search.approximate_top_k(v.filter("vec_id > 59"), v, "vec_id", "embedding", 4).collect() == []


def test_hard_negatives_of_disjoint_kinds(spark):
    hits = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7)], "query_id long, id long, score double")
    kinds = spark.createDataFrame([(1, "a", ["int"]), (2, "b", ["int"]), (3, "b", ["str"]), (4, "a", ["str"])], "id long, cls string, kinds array<string>")
    assert [(r.id, r.cls) for r in search.hard_negatives(hits, kinds, "id", "cls").collect()] == [(2, "b")]
    assert [(r.id, r.cls) for r in search.hard_negatives(hits, kinds, "id", "cls", "kinds").collect()] == [(3, "b")]


def test_bm25_equals_brute_force(spark):
    import math

    r = random.Random(2)
    docs = {i: " ".join(r.choices("alpha beta gamma delta eps".split(), k=r.randint(1, 9))) for i in range(30)}
    df = spark.createDataFrame(list(docs.items()) + [(99, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "alpha"), (1, "beta"), (1, "alpha"), (2, "nowhere")], "query_id int, term string")
    m = sum(len(t.split()) for t in docs.values()) / 30
    got = {r.doc_id: r.score for r in search.bm25(search.inverted_index(df, "doc_id", "text"), 30, m, q, "doc_id", 30).collect()}
    for i, t in docs.items():
        s = 0
        for w, qf in (("alpha", 2), ("beta", 1)):
            n, tf = sum(w in x.split() for x in docs.values()), t.split().count(w)
            s += math.log(1 + (30 - n + 0.5) / (n + 0.5)) * qf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / m))
        assert abs(got.get(i, 0) - s) < 1e-5


def test_resilient_map(spark):
    import time

    def work(v):
        if v == "slow":
            time.sleep(3)
        return int(v) ** 2

    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, "slow"), (4, None), (5, "3")], "k int, v string")
    got = {r.k: (r.status, r.result) for r in resilient_map(df, "k", "v", work, 0.5).collect()}
    assert got == {1: ("success", "4"), 2: ("exception", None), 3: ("timeout", None), 4: ("exception", None), 5: ("success", "9")}


def test_isolated_calls_survive_crashes_and_c_loops(spark):
    """A call that ends its process, and one that never leaves C code, cost only themselves."""
    import os

    def work(v):
        if v == "crash":
            os._exit(3)
        if v == "loop":
            sum(range(10**12))
        if v == "long error":
            raise ValueError("x" * 2_000)
        return v.upper()

    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "crash", "b", "loop", "c", "long error"])], "k int, v string").coalesce(1)
    got = {r.k: (r.status, r.result, r.error) for r in resilient_map(df, "k", "v", work, 1.0).collect()}
    assert [got[i][0] for i in range(6)] == ["success", "crash", "success", "timeout", "success", "exception"] and got[4][1] == "C" and len(got[5][2]) > 2_000
    square = spark.createDataFrame([(i, i) for i in range(1, 5)], "k int, v int")
    assert sorted((r.k, r.status, r.result) for r in resilient_map(square, "k", "v", lambda n: n * n, 10.0).collect()) == [(i, "success", str(i * i)) for i in range(1, 5)]
