import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.operators import labels as lb


@pytest.fixture(scope="module")
def ab(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, "y"), (3, 3.0, "z")], "k int, v double, w string")
    b = spark.createDataFrame([(2, 20.0), (3, None), (4, 40.0)], "k int, v double")
    return a, b


def test_alignment(spark, ab):
    a, b = ab
    assert {(r.k, r.v, r.w) for r in lb.combine_first(a, b, ["k"]).collect()} == {(1, 1.0, None), (2, 20.0, "y"), (3, 3.0, "z"), (4, 40.0, None)}
    assert {(r.k, r.v, r.w) for r in lb.update(a, b, ["k"]).collect()} == {(1, 1.0, None), (2, 20.0, "y"), (3, 3.0, "z")}
    assert {(r.k, r.v) for r in lb.reindex(b, spark.createDataFrame([(2,), (9,)], "k int"), ["k"], {"v": -1.0}).collect()} == {(2, 20.0), (9, -1.0)}
    w = spark.createDataFrame([(1, "v"), (3, "v"), (7, "v")], "k int, column_name string")
    assert {(r.k, r.value) for r in lb.lookup(a, "k", w, ["v"]).collect()} == {(1, 1.0), (3, 3.0), (7, None)}
    assert [r.k for r in lb.truncate(a, "k", 2, 2).collect()] == [2]


@pytest.mark.parametrize("side", ["left", "right"])
def test_searchsorted(spark, side):
    r = np.random.default_rng(1)
    s, v = np.sort(r.integers(0, 20, 50)), r.integers(-2, 23, 30)
    got = lb.searchsorted(spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i int, x int"), spark.createDataFrame([(int(x),) for x in s], "x int"), "x", "i", side)
    assert [p.place for p in got.orderBy("i").collect()] == np.searchsorted(s, v, side).tolist()


def test_statistics(spark):
    r = np.random.default_rng(2)
    p = pd.DataFrame({"i": range(60), "g": ["a"] * 40 + ["b"] * 20, "x": r.integers(0, 9, 60).astype(float), "y": r.normal(size=60)})
    s = spark.createDataFrame(p)
    want = {k: q.x.corr(q.y, method="kendall") for k, q in p.groupby("g")} if pytest.importorskip("pandas") and _scipy() else None
    got = {q.g: q.kendall for q in lb.kendall(s, "x", "y", ["g"]).collect()}
    if want:
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(-1 <= x <= 1 for x in got.values())
    auto = {q.g: q.autocorr for q in lb.autocorr(s, "y", "i", ["g"], 2).collect()}
    for k, q in p.groupby("g"):
        assert abs(auto[k] - q.y.autocorr(2)) < 1e-9
    pc = lb.pct_change(s, "x", "i", ["g"]).orderBy("i").toPandas()["pct_change"]
    with np.errstate(all="ignore"):
        w = p.groupby("g").x.pct_change()
    w = w.where(np.isfinite(w))
    np.testing.assert_allclose(pc.astype(float), w, equal_nan=True)
    assert sorted(q.i for q in lb.nth(s, ["g"], ["i"], -1).collect()) == [39, 59] and sorted(q.i for q in lb.nth(s, ["g"], ["i"], 1).collect()) == [1, 41]
    with pytest.raises(Exception, match="bound"):
        lb.kendall(s, "x", "y", ["g"], 5).collect()


def _tau(x, y):
    s, t = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    n = np.sqrt(float((s * s).sum()) * float((t * t).sum()))
    return float((s * t).sum()) / n if n else None


@pytest.mark.parametrize("block", [100_000, 70])
def test_kendall_of_any_group(spark, block):
    """A group over the former bound of 5,000 rows, ties, missing values, a null key; in one task each and over blocks."""
    r = np.random.default_rng(4)
    g = [(1, 6_000, 50), (2, 150, 4), (3, 20, 9), (4, 90, 1), (None, 300, 40), (5, 1, 5)]
    rows, want = [], {}
    for key, n, values in g:
        x = r.integers(0, values * 3, n)
        y = np.round(x * 0.3 + r.integers(0, values, n) - values / 2, 0) + 0.0
        want[key] = _tau(x, y)
        rows += [(key, int(u), float(v)) for u, v in zip(x, y)] + [(key, None, 1.0), (key, 3, None), (key, 3, float("nan"))]
    rows.append((6, None, 1.0))
    s = spark.createDataFrame(rows, "g int, x long, y double").repartition(5)
    got = lb.kendall(s, "x", "y", ["g"], block=block).collect()
    assert len(got) == len(want) and {q.g: q.kendall for q in got} == pytest.approx(want, abs=1e-12)


def _scipy():
    try:
        import scipy  # noqa: F401
    except ImportError:
        return False
    return True


def test_order_facts(spark):
    f = lambda xs: lb.order_facts(spark.createDataFrame(list(enumerate(xs)), "i int, v int"), "v", "i").first()
    assert tuple(f([1, 2, 2])) == (False, True, False) and tuple(f([3, 1])) == (True, False, True) and tuple(f([])) == (True, True, True)


def test_matrix_product(spark):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 5, (4, 3)), r.integers(0, 5, (3, 5))
    coo = lambda m: spark.createDataFrame([(i, j, int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], "i int, j int, v long")
    got = np.zeros((4, 5), int)
    for x in lb.dot(coo(a), coo(b)).collect():
        got[x.i, x.j] = x.v
    assert (got == a @ b).all()


def test_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    dim = lb.categories(df, "c", ["b", "a", "z"])
    assert sorted((r.c or "", r.code) for r in lb.encode(df, "c", dim).collect()) == [("", -1), ("a", 1), ("b", 0), ("b", 0)]
    assert {r.label: r.n for r in lb.category_counts(df, "c", dim).collect()} == {"a": 1, "b": 2, "z": 0}
    assert {r.label: r.code for r in lb.rename_categories(lb.categories(df, "c"), {"a": "x"}).collect()} == {"x": 0, "b": 1}


def test_intervals_and_ranges(spark):
    df = spark.createDataFrame([(0, 5), (5, 5)], "l int, r int")
    got = df.select(lb.in_interval(F.lit(5), F.col("l"), F.col("r")).alias("a"), lb.in_interval(F.lit(5), F.col("l"), F.col("r"), "left").alias("b"), lb.interval_facts(F.col("l"), F.col("r"))["is_empty"].alias("e"), lb.intervals_overlap((F.col("l"), F.col("r")), (F.lit(5), F.lit(9)), "both").alias("o")).collect()
    assert [tuple(x) for x in got] == [(True, False, False, True), (False, False, True, True)]
    assert lb.date_range(spark, "2024-02-27", "2024-03-02").count() == 5
    assert lb.business_date_range(spark, "2024-01-01", "2024-01-14", ["2024-01-01"]).count() == 9
    assert [(r.left, r.right) for r in lb.interval_range(spark, 0.0, 1.0, 0.5).collect()] == [(0.0, 0.5), (0.5, 1.0)]
    assert lb.infer_frequency(lb.date_range(spark, "2024-01-01", "2024-01-02", "6 HOURS"), "ts") == 21600
    assert lb.first_offset(lb.date_range(spark, "2024-01-01", "2024-01-09"), "ts", "3 DAYS").count() == 3
    assert lb.first_offset(lb.date_range(spark, "2024-01-01", "2024-01-09"), "ts", "3 DAYS", last=True).count() == 3


def test_lreshape_and_query(spark):
    df = spark.createDataFrame([(1, 5, 6, 7, None), (2, 8, 9, 10, 11)], "id int, a1 int, a2 int, b1 int, b2 int")
    assert sorted(tuple(r) for r in lb.lreshape(df, {"a": ["a1", "a2"], "b": ["b1", "b2"]}, ["id"]).collect()) == [(1, 5, 7), (2, 8, 10), (2, 9, 11)]
    assert [r.id for r in lb.query(df, "a1 == @x or (b2 in [11, 12] and not id > 5)", {"x": 99}).collect()] == [2]
    s = spark.createDataFrame([("it's", 1), ("@x == y", 2)], "s string, i int")
    assert [r.i for r in lb.query(s, "s == @t", {"t": "it's"}).collect()] == [1] and [r.i for r in lb.query(s, "s == '@x == y'").collect()] == [2]


def test_global_lag_and_fill_over_ranges(spark):
    from quillstone.operators.frame import global_ffill, global_lag

    r = np.random.default_rng(6)
    rows = [(i, None if r.random() < 0.6 else int(r.integers(0, 50))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    p = pd.DataFrame(rows, columns=["i", "v"])
    plain = lambda xs: [None if pd.isna(x) else int(x) for x in xs]
    assert [x.p for x in global_lag(df, "v", ["i"], "p").orderBy("i").collect()] == plain(p.v.shift(1))
    assert [x.v for x in global_ffill(df, ["v"], ["i"]).orderBy("i").collect()] == plain(p.v.ffill())
