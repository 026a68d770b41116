import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm import neardup


def _sets(rows):
    out = {}
    for i, t in rows:
        if i is not None and t:
            w = re.findall(r"\w+", t.lower())
            s = frozenset(zip(w, w[1:], w[2:]))
            if s:
                out[i] = s
    return out


def _brute(rows):
    s = _sets(rows)
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(s[a] & s[b]) >= 7 * len(s[a] | s[b])}


def _corpus(seed, n=140):
    r = random.Random(seed)
    common = ["the", "a", "of", "x", "y"]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 4)):
                k, op = r.randrange(len(w) + 1), r.random()
                if op < 0.4 and len(w) > 3:
                    del w[min(k, len(w) - 1)]
                elif op < 0.8:
                    w.insert(k, r.choice(common + [f"w{r.randrange(300)}"]))
                else:
                    a = min(k, len(w) // 2)
                    w = w[a:] + w[:a]
        else:
            w = [r.choice(common) if r.random() < 0.5 else f"w{r.randrange(300)}" for _ in range(r.choice([3, 4, 5, 6, 8, 12, 30, 70, 150]))]
        rows.append((i + 1, " ".join(w)))
    return rows


def _found(spark, rows, dearest=None):
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "rec_id long, code string, tbl string, key int").repartition(3)
    links, members = neardup.near_duplicates([neardup.run_sets(df, "t", "rec_id", "code")], dearest)
    return neardup.pairs_of(links, members), links, members


@pytest.mark.parametrize("seed,dearest", [(1, None), (2, None), (3, 12), (4, 3), (5, 0)])
def test_equals_brute_force(spark, seed, dearest):
    """With dearest=0 every record goes the exact way of the hard ones, with 3 and 12 some do."""
    rows = _corpus(seed)
    got = [(r.row_a, r.row_b) for r in _found(spark, rows, dearest)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_edges(spark):
    text = "alpha beta gamma delta epsilon"
    rows = [(1, text), (2, text.upper().replace(" ", "\n-")), (2, text.upper().replace(" ", "\n-")), (3, None), (4, ""), (5, "one two"), (None, text), (6, "long " * 30_000 + text), (7, "long " * 40_000 + text), (8, "one two")]
    pairs, links, members = _found(spark, rows)
    assert {(r.row_a, r.row_b) for r in pairs.collect()} == {(1, 2), (6, 7)}
    empty = [(None, None)]
    assert _found(spark, empty)[0].collect() == []


@pytest.mark.parametrize("dearest", [None, 0])
def test_hot_keys_are_split(spark, monkeypatch, dearest):
    """One run of words in nine tenths of the records: its keys are cut into parts, and no pair is lost or doubled."""
    r = random.Random(11)
    rows = [(i, ("one common start " if i % 10 else "") + " ".join(f"w{r.randrange(60)}" for _ in range(r.choice([2, 3, 4])))) for i in range(1, 400)]
    for name, v in (("SAMPLE", 150), ("SEEN", 5), ("SPLIT", 10)):
        monkeypatch.setattr(neardup, name, v)
    seen = []
    real = neardup.split_keys

    def watch(sig, hot, bits):
        out = real(sig, hot, bits)
        index = F.col("meta").bitwiseAND(F.lit(3)) == neardup.INDEX
        seen.append((sig.filter(index).groupBy("key").count().agg(F.max("count")).first()[0], out.filter(index).groupBy("key").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(neardup, "split_keys", watch)
    got = [(x.row_a, x.row_b) for x in _found(spark, rows, dearest)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    if dearest is None:
        assert seen[0][0] > 100 and seen[0][1] <= 30


def test_large_ids(spark):
    """Ids beyond what can be numbered in place: classes keep apart, links come back under the ids given."""
    rows = [((1 << 62) + i if i % 2 else -(1 << 62) - i, t) for i, t in _corpus(6, 60)]
    got = [(x.row_a, x.row_b) for x in _found(spark, rows)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_sketch_is_an_upper_estimate(spark):
    import numpy as np

    r = random.Random(2)
    sets = [sorted({r.randrange(500) * 7919 for _ in range(40)}) for _ in range(300)]
    freq = neardup.frequencies(spark.createDataFrame([(s,) for s in sets], "runs array<long>"), 1 << 17)
    runs = np.array(sorted({x for s in sets for x in s}), np.int64)
    true = np.array([sum(x in s for s in map(set, sets)) for x in runs.tolist()])
    assert len(freq) == 1 << 17 and (neardup.estimate(freq, runs.view(np.uint64)) >= true).all() and (neardup.estimate(freq, runs.view(np.uint64)) <= np.maximum(32, true * 1.2 + 10)).all()


def test_large_classes_are_expanded(spark, monkeypatch):
    """501 variants of one text in letter case and punctuation, and two of another text near to it: every pair is returned."""
    text = "same words in every row here and there"
    rows = [(i, (text.upper() if i % 2 else text) + "." * (i % 5)) for i in range(1, 502)] + [(900, text + " more"), (901, text + " More!")]
    for part in (neardup.PART, 100):
        monkeypatch.setattr(neardup, "PART", part)
        got = [(r.row_a, r.row_b) for r in _found(spark, rows)[0].collect()]
        ids = sorted(i for i, _ in rows)
        assert len(got) == len(set(got)) and set(got) == {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}


def test_groups_are_components(spark):
    rows = _corpus(9, 200)
    _, links, members = _found(spark, rows)
    got = {r.row_id: r.group_id for r in neardup.groups_of(links, members).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in _brute(rows):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for p in _brute(rows) for x in p}
    assert got == {i: root(i) for i in linked}


def test_tables_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta")], "rec_id long, code string")
    links, members = neardup.near_duplicates([neardup.run_sets(df, "t", "rec_id", "code"), neardup.run_sets(df, "u", "rec_id", "code")])
    assert neardup.pairs_of(links, members).collect() == [] and members.count() == 2
