import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.operators import compare, frame as fr, joins
from quillstone.sources.tables import nan_to_null


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    n = 200
    p = pd.DataFrame({"i": np.arange(n), "k": r.choice(["a", "b", "c", None], n, p=[0.5, 0.3, 0.1, 0.1]), "v": np.round(r.normal(0, 9, n), 1), "x": r.integers(0, 8, n)})
    p.loc[r.choice(n, 40, replace=False), "v"] = np.nan
    rows = [(int(a), b, None if pd.isna(c) else float(c), int(d)) for a, b, c, d in p.itertuples(index=False)]
    return p, spark.createDataFrame(rows, "i long, k string, v double, x long")


def _pd(df, order="i"):
    return df.toPandas().sort_values(order).reset_index(drop=True)


def test_arithmetic_like_pandas(spark):
    a = pd.Series([-7, 7, -8, 5])
    df = spark.createDataFrame([(int(x),) for x in a], "a int")
    got = df.select(fr.floordiv(F.col("a"), F.lit(2)).alias("f"), fr.mod(F.col("a"), F.lit(-3)).alias("m"), fr.floordiv(F.col("a"), F.lit(0)).alias("z")).toPandas()
    assert got.f.tolist() == (a // 2).tolist() and got.m.tolist() == (a % -3).tolist() and got.z.isna().all()


def test_comparisons_with_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "a double")
    got = nan_to_null(df).select(fr.compare(F.col("a"), "lt", F.lit(2)).alias("lt"), fr.compare(F.col("a"), "ne", F.lit(1)).alias("ne")).toPandas()
    assert got["lt"].tolist() == [True, False, False] and got["ne"].tolist() == [False, True, True]


@pytest.mark.parametrize("method", ["average", "min", "max", "first", "dense"])
@pytest.mark.parametrize("pct", [False, True])
def test_rank(data, method, pct):
    p, s = data
    got = _pd(fr.rank(s, "v", method, tie=["i"], pct=pct))["rank"]
    want = p.v.rank(method=method, pct=pct)
    pd.testing.assert_series_equal(got.astype(float), want, check_names=False)


def test_fills(data):
    p, s = data
    q = p[p.k.notna()]
    got = _pd(fr.ffill(s.filter("k is not null"), ["v"], ["i"], ["k"], 2)).v
    want = q.groupby("k").v.ffill(limit=2).reset_index(drop=True)
    pd.testing.assert_series_equal(got, want, check_names=False)
    got = _pd(fr.ffill(s.filter("k is not null"), ["v"], ["i"], ["k"], backward=True)).v
    pd.testing.assert_series_equal(got, q.groupby("k").v.bfill().reset_index(drop=True), check_names=False)


def test_rolling(data):
    p, s = data
    one = s.withColumn("g", F.lit(1))
    stats = ["mean", "std", "median", "skew", "kurt", "min"]
    got = _pd(fr.rolling(one, "v", ["i"], ["g"], 9, stats, 5))
    r = p.v.rolling(9, min_periods=5)
    for st in stats:
        np.testing.assert_allclose(got[f"roll_{st}"].astype(float), getattr(r, st)().astype(float), rtol=1e-6, atol=1e-6, equal_nan=True)


def test_ewm_and_cumulative(data):
    p, s = data
    one = s.withColumn("g", F.lit(1))
    got = _pd(fr.ewm_mean(one, "v", ["i"], ["g"], 0.3)).ewm_mean
    np.testing.assert_allclose(got.astype(float), p.v.ewm(alpha=0.3, adjust=True).mean(), rtol=1e-9, equal_nan=True)
    got = _pd(fr.cumulative(one, "v", ["i"], ["g"], ["sum", "max"]))
    np.testing.assert_allclose(got.cum_sum.astype(float), p.v.cumsum(), rtol=1e-9, equal_nan=True)


def test_interpolate(data):
    p, s = data
    got = _pd(fr.interpolate(s.withColumn("g", F.lit(1)), "v", "i", ["g"])).v
    np.testing.assert_allclose(got.astype(float), p.v.interpolate(), rtol=1e-9, equal_nan=True)


def test_moments_and_quantiles(data):
    p, s = data
    got = s.agg(fr.skew("v").alias("a"), fr.kurt("v").alias("b"), fr.sem("v").alias("c")).first()
    np.testing.assert_allclose([got.a, got.b, got.c], [p.v.skew(), p.v.kurt(), p.v.sem()])
    for how in ("linear", "lower", "higher", "midpoint", "nearest"):
        q = fr.quantile(s.withColumn("g", F.lit(1)), "v", 0.37, ["g"], how).first()["quantile"]
        assert abs(q - p.v.quantile(0.37, interpolation=how)) < 1e-9
    assert s.limit(0).agg(fr.total("v").alias("t")).first().t == 0


def test_mode_factorize_duplicates(data):
    p, s = data
    assert sorted(r.x for r in fr.mode(s, "x").collect()) == p.x.mode().tolist()
    got = _pd(fr.factorize(s, "k", "i"))["code"].tolist()
    assert got == pd.factorize(p.k)[0].tolist()
    for keep in ("first", "last", False):
        want = p.drop_duplicates(["k", "x"], keep=keep).i.tolist()
        assert sorted(r.i for r in fr.drop_duplicates(s, ["k", "x"], ["i"], keep).collect()) == sorted(want)
        assert [r.is_duplicate for r in fr.duplicated(s, ["k", "x"], ["i"], keep).orderBy("i").collect()] == p.duplicated(["k", "x"], keep=keep).tolist()


def test_positions_and_largest(data):
    p, s = data
    got = _pd(fr.position(s, ["x", "i"], "pos"))
    assert got.pos.tolist() == p.sort_values(["x", "i"]).reset_index().reset_index().sort_values("i")["level_0"].tolist()
    assert sorted(r.i for r in fr.nlargest(s, 7, "v", "i").collect()) == sorted(p.nlargest(7, "v").i)
    assert {r.i for r in fr.nlargest(s, 5, "x", "i", "all").collect()} == set(p.nlargest(5, "x", keep="all").i)
    assert [r.i for r in fr.take(s, ["i"], [0, 5, -1]).orderBy("i").collect()] == [0, 5, 199]


def test_merge_rules(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    got = {(r.k, r.v_x, r.v_y, r.merge_side) for r in joins.merge(a, b, ["k"], "outer", indicator=True).collect()}
    assert got == {(1, "x", "p", "both"), (None, "y", "q", "both"), (2, "z", None, "left_only"), (3, None, "r", "right_only")}
    assert {r.v for r in joins.merge(a, b, ["k"], "anti").collect()} == {"z"} and joins.merge(a, b, ["k"], "semi").count() == 2
    with pytest.raises(ValueError):
        joins.merge(a.union(a), b, ["k"], validate="one_to_one")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_like_pandas(spark, direction, exact):
    r = np.random.default_rng(8)
    left = pd.DataFrame({"t": np.sort(r.choice(200, 60, replace=False)), "g": r.integers(0, 3, 60)})
    left["id"] = np.arange(60)
    right = pd.DataFrame({"t": np.sort(r.choice(200, 40, replace=False)), "g": r.integers(0, 3, 40)})
    right["v"] = np.arange(40) * 10
    want = pd.merge_asof(left, right, on="t", by="g", direction=direction, allow_exact_matches=exact, tolerance=9).v
    s = lambda p: spark.createDataFrame([tuple(map(int, x)) for x in p.itertuples(index=False)], ", ".join(f"{c} long" for c in p.columns))
    got = joins.asof(s(left), s(right), "t", ["g"], ["v"], direction, F.lit(9), exact, "id").orderBy("id").toPandas().v
    np.testing.assert_array_equal(got.astype(float), want.astype(float))


def test_reshape(spark):
    df = spark.createDataFrame([("a", "u", 1), ("a", "w", 2), ("b", "u", 3), ("b", "u", 4)], "i string, c string, v int")
    got = {r.i: (r.u, r.w, r.t) for r in fr.pivot_table(df, ["i"], "c", ["u", "w"], F.sum("v"), 0, "t").collect()}
    assert got == {"a": (1, 2, 3), "b": (7, 0, 7)}
    wide = spark.createDataFrame([(1, 5, 6)], "id int, m_1 int, m_2 int")
    assert {(r.j, r.m) for r in fr.wide_to_long(wide, "m", ["id"]).collect()} == {("1", 5), ("2", 6)}
    assert [r.b for r in df.select(fr.cut(F.col("v"), [0, 2, 4]).alias("b")).collect()] == [0, 0, 1, 1]
    assert fr.concat([df, wide], ["p", "q"]).count() == 5 and fr.concat([df, df.drop("c")], join="inner").columns == ["i", "v"]


def test_tolerant_compare(spark):
    a = spark.createDataFrame([(1, 2.0000000001, "x"), (3, None, "y")], "a int, b double, c string")
    b = spark.createDataFrame([("y", 3.0, None), ("x", 1.0, 2.0)], "q string, r double, s double")
    assert compare.same(a, b) and not compare.same(a, b.limit(1)) and not compare.same(a, b.drop("q"))
    assert not compare.same(a, b.withColumn("r", F.col("r") + 1)) and compare.same(a.limit(0), b.limit(0))
