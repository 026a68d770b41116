import os

import pytest

from quillstone.llm import bpe, mixing

tokenizers = pytest.importorskip("tokenizers")
PATH = os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encode_equals_reference_and_round_trips(reference):
    import random

    a, r = bpe.automaton(bpe.compiled(PATH)), random.Random(5)
    bits = ["aaaa", "ab", "the", "zzz", "==", "----", "   ", "\n", "é", "日本", "😀", "ing", "ization", "'s", "1234", "​", "<|endoftext|>"]
    for s in ["", *["a" * n for n in range(1, 60)], *["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(2000)]]:
        assert a.encode(s) == reference(s)
        assert a.decode(a.encode(s)) == s


def _merged(word, merges):
    """The merge procedure itself: the first merge that applies, everywhere from the left, until none does."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = next((m for m in merges if any(p == m for p in zip(parts, parts[1:]))), None)
        if found is None:
            return parts
        out, i = [], 0
        while i < len(parts):
            hit = tuple(parts[i : i + 2]) == found
            out.append(b"".join(parts[i : i + 1 + hit]))
            i += 1 + hit
        parts = out


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_equal_the_merge_procedure_on_small_vocabularies(seed):
    import itertools
    import random

    r, tokens, merges = random.Random(seed), [b"a", b"b"], []
    while len(merges) < 9:
        a, b = (r.choice(tokens[: 2 + len(merges)]) for _ in range(2))
        if a + b not in tokens and (a, b) not in merges and _merged(a + b, merges) == [a, b]:
            merges.append((a, b))
            tokens.append(a + b)
    made = bpe.automaton(bpe.compile_automaton(dict(enumerate(tokens)), merges))
    for n in range(1, 9):
        for w in itertools.product(b"ab", repeat=n):
            word = bytes(w)
            assert [tokens[i] for i in made.run(word)] == _merged(word, merges)


def test_encode_table_edge_cases(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, " \n", "x"), (4, long, None), (4, long, None)], "doc_id long, text string, ids string")
    got = {}
    for r in bpe.encode_table(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert got[1] == [[]] and got[2] == [[]] and len(got[4]) == 2 and got[4][0] == got[4][1] and None in got
    assert bpe.encode_table(df.limit(0), "doc_id", "text").collect() == []


def _brute(docs, targets, budget, seed_order):
    queue = []
    for s, (share, reps) in targets.items():
        cum = 0
        for rep in range(reps):
            for d, n in sorted(((d, n) for x, d, n in docs if x == s), key=lambda t: (seed_order[rep, t[0]], t[0])):
                cum += n
                queue.append((cum / share, s, d, rep, n))
    out, total = set(), 0
    for f, s, d, rep, n in sorted(queue):
        total += n
        if total <= budget:
            out.add((s, d, rep))
    return out


@pytest.mark.parametrize("rows", [3, 50_000])
def test_fair_mix_equals_brute_force(spark, rows):
    from pyspark.sql import functions as F

    docs = [("a", i, 5 + i % 7) for i in range(40)] + [("b", 100 + i, 9) for i in range(12)] + [("c", 200, 3)] + [("none", 300 + i, 4) for i in range(5)] + [(None, 400, 3), ("a", 401, 0)]
    targets = {"a": (0.3, 1), "b": (0.5, 3), "c": (0.1, 2), "absent": (0.1, 2)}
    df = spark.createDataFrame(docs, "source string, doc_id long, n_tokens long")
    td = spark.createDataFrame([(s, a, b, "x") for s, (a, b) in targets.items()] + [(None, 0.2, 1, "x")], "source string, target_share double, max_repeats int, n_tokens string")
    order = {(r.copy, r.doc_id): r.u for r in df.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("copy"))).select("copy", "doc_id", mixing._unit(F.lit(7), F.col("copy"), F.col("doc_id")).alias("u")).collect()}
    mix = mixing.fair_mix(df, td, rows=rows)
    live = [x for x in docs if x[0] in targets and x[2]]
    assert {(r.source, r.doc_id, r.copy) for r in mix.collect()} == _brute(live, targets, sum(n for _, _, n in live), order)
    got = {r.source: r for r in mixing.shares(mix, df, td).collect()}
    assert got["absent"].tokens == 0 and abs(sum(r.actual_share for r in got.values() if r.source) - 1) < 1e-9
    assert all(r.repeats <= r.max_repeats for r in got.values())


def test_uneven_shares_leave_no_hot_range(spark):
    """Shares of 0.999 and 0.001 over equal tokens: ranges of the global order keep to equal numbers of rows."""
    from pyspark.sql import functions as F

    n = 20_000
    docs = spark.range(2 * n).select(F.when(F.col("id") < n, "big").otherwise("tiny").alias("source"), F.col("id").alias("doc_id"), F.lit(10).alias("n_tokens"))
    td = spark.createDataFrame([("big", 0.999, 3), ("tiny", 0.001, 1)], "source string, target_share double, max_repeats int")
    seen = {}
    real = mixing.materialize
    mixing.materialize = lambda df, name="part": seen.setdefault(name, real(df, name))
    try:
        mix = mixing.fair_mix(docs, td, budget=300_000)
    finally:
        mixing.materialize = real
    sizes = sorted(r["count"] for r in seen["p9r"].groupBy("part").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and seen["p9r"].filter("source = 'big'").count() == 3 * n
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    assert {r.source: r.t for r in got} == {"big": 299_700, "tiny": 300}


def test_copies_stop_with_the_budget(spark):
    docs = spark.createDataFrame([("a", i, 10) for i in range(100)] + [("b", 100 + i, 10) for i in range(100)], "source string, doc_id long, n_tokens long")
    td = spark.createDataFrame([("a", 0.5, 100_000), ("b", 0.5, 100_000)], "source string, target_share double, max_repeats int")
    got = mixing.fair_mix(docs, td, budget=3_000).collect()
    assert sum(r.n_tokens for r in got) == 3_000 and {r.copy for r in got} == {0, 1}


def test_fair_mix_empty(spark):
    td = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.fair_mix(spark.createDataFrame([], "source string, doc_id long, n_tokens long"), td).collect() == []
