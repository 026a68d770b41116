from collections import Counter

from pyspark.sql import functions as F

from quillstone.operators import skew
from quillstone.plans import skew_queries


def _write(spark, d, rows):
    spark.createDataFrame(rows, "item_id long, key string, template string, support long, extra string").write.mode("overwrite").parquet(f"{d}/preprocessed_items.parquet")


def test_misra_gries_keeps_heavy():
    data = ["a"] * 400 + ["b"] * 300 + [f"x{i}" for i in range(600)]
    got = skew.misra_gries(iter([data[i : i + 50] for i in range(0, len(data), 50)]), 10)
    assert {"a", "b"} <= set(got) and len(got) <= 10


def test_found_counts_records_once_and_keeps_ties(spark, tmp_path):
    rows = [(i, f"Own/{i}:1", " t1 ", 1, None) for i in range(2)] + [(i, None, None, None, "x") for i in range(2, 98)]
    rows += [(98, "oWN/z", "\tt1\n", 0, None), (99, "b", "  ", 3, None)] + [(99, "b", "  ", 3, None)] * 50
    _write(spark, tmp_path, rows)
    got = {tuple(r) for r in skew_queries.found(spark, str(tmp_path)).collect()}
    assert got == {("template", "t1"), ("owner", "own")}  # 3 of 100; "b" has one record however often delivered


def test_found_empty(spark, tmp_path):
    _write(spark, tmp_path, [])
    assert skew_queries.found(spark, str(tmp_path)).collect() == []
    assert skew_queries.template_support(spark, str(tmp_path)).collect() == []


def test_aggregate_skewed_equals_group_by(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 70}", i) for i in range(500)] + [(None, 1)] * 20
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = {r.k: (r.s, r.n) for r in skew.aggregate_skewed(df, "k", {"s": F.sum("v"), "n": F.count(F.lit(1))}).collect()}
    want = {k: (sum(v for x, v in rows if x == k), n) for k, n in Counter(x for x, _ in rows if x).items()}
    assert got == want
