"""Queries of labelled axes: alignment, searching, categories, intervals and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.operators import labels as lb
from quillstone.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, s_acctbal) AS v FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def combine_first(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"))
    return lb.combine_first(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query("SELECT c_custkey AS k, coalesce(s_acctbal, c_acctbal) AS v FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def update_values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return lb.update(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query("SELECT p_partkey AS k, coalesce(s_acctbal, -1) AS s_acctbal FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def reindex(spark: SparkSession, d: str) -> DataFrame:
    return lb.reindex(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal"), table(spark, d, "part").select(F.col("p_partkey").alias("k")), ["k"], {"s_acctbal": -1.0})


@query("SELECT s_suppkey, (SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) AS place FROM supplier")
def searchsorted(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier", "s_suppkey", "s_acctbal"), table(spark, d, "customer", "c_acctbal")
    return lb.searchsorted(s.withColumnRenamed("s_acctbal", "v"), c.withColumnRenamed("c_acctbal", "v"), "v", "s_suppkey").withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id, round(corr(value, p), 7) AS autocorr FROM (SELECT user_id, value, lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return lb.autocorr(table(spark, d, "events", "user_id", "event_id", "value"), "value", "event_id", ["user_id"], 2).select("user_id", F.round("autocorr", 7).alias("autocorr"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 2")
def group_nth(spark: SparkSession, d: str) -> DataFrame:
    return lb.nth(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], -2).select("o_custkey", "o_orderkey")


@query("SELECT event_id, round(value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) - 1, 8) AS pct_change FROM events")
def pct_change(spark: SparkSession, d: str) -> DataFrame:
    return lb.pct_change(table(spark, d, "events", "event_id", "user_id", "value"), "value", "event_id", ["user_id"]).select("event_id", F.round("pct_change", 8).alias("pct_change"))


@query("SELECT label, count(event_type) AS n FROM (VALUES ('view'), ('click'), ('refund')) t(label) LEFT JOIN events ON event_type = label GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type")
    return lb.category_counts(e, "event_type", lb.categories(e, "event_type", ["view", "click", "refund"]))


@query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS BIGINT) AS code FROM events")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type")
    return lb.encode(e, "event_type", lb.categories(e, "event_type")).select("event_id", "code")


@query("SELECT count(DISTINCT ts) = count(ts) AS is_unique, true AS is_increasing, false AS is_decreasing FROM events")
def order_facts(spark: SparkSession, d: str) -> DataFrame:
    return lb.order_facts(table(spark, d, "events", "event_id", "ts"), "ts", "event_id")


@query("SELECT a.l_suppkey AS i, b.p_size AS j, CAST(sum(a.l_linenumber) AS BIGINT) AS v FROM lineitem a JOIN part b ON a.l_partkey = b.p_partkey GROUP BY 1, 2")
def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_linenumber").cast("long").alias("v"))
    return lb.dot(a, table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("j"), F.lit(1).cast("long").alias("v")))


@query("SELECT p_partkey, p_size > 10 AND p_size <= 20 AS in_right, p_size >= 10 AND p_size < 20 AS in_left, (p_size + 30) / 2.0 AS mid FROM part")
def interval_membership(spark: SparkSession, d: str) -> DataFrame:
    x, a, b = F.col("p_size"), F.lit(10), F.lit(20)
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", lb.in_interval(x, a, b).alias("in_right"), lb.in_interval(x, a, b, "left").alias("in_left"), lb.interval_facts(x, F.lit(30))["mid"].alias("mid"))


@query("SELECT ts FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS ts) WHERE isodow(ts) < 6 AND ts <> TIMESTAMP '2024-12-25'")
def business_calendar(spark: SparkSession, d: str) -> DataFrame:
    return lb.business_date_range(spark, "2024-01-01", "2024-12-31", ["2024-12-25"])


@query("SELECT event_id FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def first_days(spark: SparkSession, d: str) -> DataFrame:
    return lb.first_offset(table(spark, d, "events", "event_id", "ts"), "ts", "3 DAY").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 150000 OR o_orderpriority IN ('1-URGENT', '5-LOW'))")
def query_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return lb.query(o, "o_orderstatus == 'F' and (o_totalprice > @limit or o_orderpriority in @some)", {"limit": 150000, "some": ["1-URGENT", "5-LOW"]}).select("o_orderkey")


@query("SELECT o_custkey, kind, v FROM (SELECT o_custkey, 'n' AS kind, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'total', round(sum(o_totalprice), 2) FROM orders GROUP BY 1)")
def stack_aggregates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.unpivot(["o_custkey"], ["n", "total"], "kind", "v")


@query("SELECT user_id, round(sum(sign((a.event_id - b.event_id) * (a.value - b.value))) / sqrt(sum(CASE WHEN a.event_id <> b.event_id THEN 1.0 ELSE 0 END) * sum(CASE WHEN a.value <> b.value THEN 1.0 ELSE 0 END)), 9) AS kendall FROM events a JOIN events b USING (user_id) WHERE a.event_id < b.event_id GROUP BY 1")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    x = lb.kendall(table(spark, d, "events", "user_id", "event_id", "value"), "event_id", "value", ["user_id"])
    return x.select("user_id", F.round("kendall", 9).alias("kendall"))
