import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates, text as tx
from quillstone.operators import axes as ax, frame as fr, skew, trace


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "c", 5.0), (3, "c", 5.0)], "k int, s string, v double")


def test_selection_by_label(spark, small):
    assert sorted(r.k for r in ax.loc(small, "k", [1, 3], columns=["v"]).collect()) == [1, 3, 3]
    assert [r.k for r in ax.loc(small, "k", between=(None, 2)).orderBy("k").collect()] == [1, 2]
    with pytest.raises(KeyError):
        ax.loc(small, "k", [1, 9])
    assert ax.at(small, {"k": 2}, "v") is None and ax.at(small, {"s": None}, "k") == 2
    with pytest.raises(KeyError):
        ax.at(small, {"k": 7}, "v")
    with pytest.raises(ValueError):
        ax.at(small, {"k": 3}, "v")
    assert ax.iat(small, ["k"], 1, "k") == 2 and ax.iat(small, ["k"], -1, "k") == 3
    with pytest.raises(IndexError):
        ax.iat(small.limit(0), ["k"], 0, "k")
    assert ax.xs(small, "s", None).columns == ["k", "v"] and ax.xs(small, "s", "c").count() == 2
    assert ax.squeeze(small.select(F.max("v"))) == 5.0 and ax.squeeze(small).count() == 4
    r = ax.facts(small).first()
    assert (r.n_rows, r.n_columns, r.size, r.is_empty, sorted(r.has_nulls)) == (4, 3, 12, False, ["s", "v"])
    assert ax.facts(small.limit(0)).first().is_empty


def test_index_edits(spark, small):
    assert [r.k for r in ax.delete(small, ["k"], [0]).orderBy("k").collect()] == [2, 3, 3]
    got = ax.insert(small, ["k"], 1, {"k": 9, "v": 1.5}).orderBy("place").collect()
    assert [(r.place, r.k, r.s) for r in got][:3] == [(0, 1, "a"), (1, 9, None), (2, 2, None)]
    assert [r.k for r in ax.repeat(small, F.col("v") - 3).collect()] == [3, 3, 3, 3]
    assert ax.from_product(spark, {"a": [1, 2], "b": ["x"]}).count() == 2
    assert tuple(ax.first_valid(small, "v", "k").first()) == (1, 3) and tuple(ax.first_valid(small.limit(0), "v", "k").first()) == (None, None)
    assert sorted(r.place for r in ax.recode(small, "s").collect()) == [-1, 0, 1, 1]


def test_conversions(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "x", None), (None, "2", "false", "2", None)], "a string, b string, c string, d string, e string")
    assert [t for _, t in ax.convert_types(df).dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert [t for _, t in ax.convert_types(df.limit(0)).dtypes] == ["string"] * 5
    x = ax.evaluate(spark.createDataFrame([(3, 4)], "a int, b int"), "c = a ** 2 + b ** 2\nd = c == @n", {"n": 25}).first()
    assert x.c == 25 and x.d
    with pytest.raises(ValueError):
        ax.evaluate(df, "a + 1")


def test_exponential_moments_equal_pandas(spark):
    r = np.random.default_rng(1)
    rows = [(g, i, None if r.random() < 0.2 else float(r.normal()), float(r.normal())) for g in range(3) for i in range(40)] + [(9, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double").repartition(5)
    for how in ({"com": 2.0}, {"span": 5.0}, {"halflife": 3.0}, {"alpha": 0.4}):
        for adjust in (True, False):
            got = {(q.g, q.i): (q.ewm_mean, q.ewm_var, q.ewm_std) for q in fr.ewm(df, ["x"], ["i"], ["g"], fr.ewm_alpha(**how), ["mean", "var", "std"], adjust).collect()}
            both = {(q.g, q.i): (q.ewm_cov, q.ewm_corr) for q in fr.ewm(df, ["x", "y"], ["i"], ["g"], fr.ewm_alpha(**how), ["cov", "corr"], adjust).collect()}
            for g, p in pd.DataFrame(rows, columns=["g", "i", "x", "y"]).groupby("g"):
                e = p.x.astype(float).ewm(adjust=adjust, **how)
                want = pd.DataFrame({"m": e.mean(), "v": e.var(), "s": e.std(), "c": e.cov(p.y), "r": e.corr(p.y)})
                for i, w in zip(p.i, want.itertuples(index=False)):
                    for a, b in zip([*got[g, i], both[g, i][0]], [w.m, w.v, w.s, w.c]):
                        assert (a is None and np.isnan(b)) or (a is not None and abs(a - b) < 1e-9), (how, adjust, g, i, a, b)
    with pytest.raises(ValueError):
        fr.ewm_alpha(com=1, span=2)


def test_global_rank_equals_pandas(spark):
    v = [3.0, 1.0, 3.0, None, 2.0, 1.0, 3.0]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    for m in ("average", "min", "max", "dense", "first"):
        for pct in (False, True):
            for up in (True, False):
                got = [r["rank"] for r in fr.rank(df, "v", m, tie=["i"], pct=pct, ascending=up).orderBy("i").collect()]
                want = pd.Series(v).rank(method=m, pct=pct, ascending=up)
                assert all((a is None and np.isnan(b)) or abs(a - b) < 1e-12 for a, b in zip(got, want)), (m, pct, up)
    assert fr.rank(df.limit(0), "v", "min").collect() == []


def test_buckets_equal_pandas(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=30 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    s = pd.Series([v for _, v in rows], index=[t for t, _ in rows])
    for closed in ("left", "right"):
        for label in ("left", "right"):
            got = {r.bucket: r.n for r in fr.resample(df, "t", "5 hours", {"n": F.sum("v")}, closed=closed, label=label, offset="2 hours").collect()}
            want = s.resample("5h", closed=closed, label=label, origin=dt.datetime(1970, 1, 1, 2)).sum()
            assert got == {k.to_pydatetime(): v for k, v in want.items()}
    r = fr.rolling_time(df.withColumn("g", F.lit(1)), "v", "t", ["g"], 7200, ["sum"], closed="left").orderBy("t").collect()
    want = s.rolling("2h", closed="left", min_periods=1).sum()
    assert all((a.roll_sum is None and np.isnan(b)) or a.roll_sum == b for a, b in zip(r, want))


def test_offsets_equal_pandas(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=17 * i) for i in range(45)] + [dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2023, 3, 31), dt.date(2023, 4, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for unit, end, off in (("month", True, pd.offsets.MonthEnd), ("month", False, pd.offsets.MonthBegin), ("quarter", True, pd.offsets.QuarterEnd), ("year", True, pd.offsets.YearEnd), ("year", False, pd.offsets.YearBegin)):
        for n in (1, 2, -1, -3):
            got = df.select("d", dates.period_edge(F.col("d"), unit, n, end).alias("x")).collect()
            assert all(pd.Timestamp(r.x) == pd.Timestamp(r.d) + off(n) for r in got), (unit, end, n)


def test_texts(spark):
    df = spark.createDataFrame([("a", "b"), (None, "c")], "x string, y string")
    assert [r[0] for r in df.select(tx.cat([F.col("x"), F.col("y")], "-")).collect()] == ["a-b", None]
    assert [r[0] for r in df.select(tx.cat([F.col("x"), F.col("y")], "-", "?")).collect()] == ["a-b", "?-c"]
    lines = spark.createDataFrame([("the quick brown fox",)], "t string").select(tx.wrap(F.col("t"), 9)).first()[0]
    assert lines == "the quick\nbrown fox"
    d = spark.createDataFrame([("2 days 03:04:05",), ("-1 days",), ("x",), (None,), ("01:00:00",)], "t string").select(dates.seconds_of(F.col("t"))).collect()
    assert [r[0] for r in d] == [2 * 86400 + 3 * 3600 + 245.0, -86400.0, None, None, 3600.0]
    c = spark.createDataFrame([("9:05",), ("12:30 am",), ("1:02:03 PM",), ("25:00",)], "t string").select(dates.time_of(F.col("t"))).collect()
    assert [r[0] for r in c] == ["09:05:00", "00:30:00", "13:02:03", None]


def test_pearson_of_constants_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "g int, a double, b double")
    got = {r.g: r.c for r in df.groupBy("g").agg(fr.pearson("a", "b").alias("c")).collect()}
    assert got[1] is None and abs(got[2] - 1) < 1e-12


def test_heavy_keys_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 5}", i) for i in range(100)], "k string, v int")
    monkeypatch.setattr(skew, "MAX_CANDIDATES", 2)
    got = {r.k: r.s for r in skew.aggregate_skewed(df, "k", {"s": F.sum("v")}, 0.1).collect()}
    assert got == {f"k{j}": sum(range(j, 100, 5)) for j in range(5)}
    with pytest.raises(ValueError):
        skew.aggregate_skewed(df, "k", {"s": F.collect_list("v")})


def test_merged_ranges(spark):
    """x is defined, y = x, z = y: one range; w is another."""
    r = spark.createDataFrame([(1, "x", 0, 1, 1, 3), (1, "y", 0, 1, 4, 6), (1, "z", 0, 1, 7, 9), (1, "w", 0, 1, 20, 21)], "run_id long, name string, scope_id long, range_no long, start_seq long, end_seq long")
    c = spark.createDataFrame([(1, 0, 4, 3), (1, 0, 7, 6), (1, 0, 20, 8)], "run_id long, scope_id long, def_seq long, access_seq long")
    assert {x.name: x.root_seq for x in trace.merge_ranges(r, c).collect()} == {"x": 1, "y": 1, "z": 1, "w": 20}
    assert trace.merge_ranges(r.limit(0), c).collect() == []
