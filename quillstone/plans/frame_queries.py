"""Queries of the data-frame vocabulary over the star schema and the event table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.operators import frame as fr, joins
from quillstone.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, CAST(o_custkey // 7 AS BIGINT) AS floor_div, CAST(o_custkey % 7 AS BIGINT) AS remainder, round(o_totalprice - 1000, 2) AS shifted, o_totalprice > 100000 AS is_large, CASE WHEN o_totalprice < 50000 THEN 50000 WHEN o_totalprice > 200000 THEN 200000 ELSE o_totalprice END AS clipped FROM orders")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k, p = F.col("o_custkey"), F.col("o_totalprice")
    return o.select("o_orderkey", fr.floordiv(k, F.lit(7)).alias("floor_div"), fr.mod(k, F.lit(7)).cast("long").alias("remainder"), F.round(p - 1000, 2).alias("shifted"), fr.compare(p, "gt", F.lit(100000)).alias("is_large"), fr.clip(p, 50000.0, 200000.0).alias("clipped"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE -1 END AS big_size, CASE p_brand WHEN 'Brand#11' THEN 'a' WHEN 'Brand#22' THEN 'b' END AS mapped, p_size BETWEEN 10 AND 20 AS is_mid FROM part")
def conditional_values(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size", "p_brand")
    return p.select("p_partkey", fr.where(F.col("p_size"), F.col("p_size") > 25, -1).alias("big_size"), fr.map_values(F.col("p_brand"), {"Brand#11": "a", "Brand#22": "b"}).alias("mapped"), F.col("p_size").between(10, 20).alias("is_mid"))


@query("SELECT s_suppkey, s_name, CAST(p AS BIGINT) AS position FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS p FROM supplier) WHERE p IN (0, 3, 7, (SELECT count(*) - 1 FROM supplier))")
def take_positions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    return fr.take(s, ["s_acctbal", "s_suppkey"], [0, 3, 7, -1]).select("s_suppkey", "s_name", F.col("position").cast("long").alias("position"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")
def global_position(spark: SparkSession, d: str) -> DataFrame:
    return fr.position(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, rank() OVER (ORDER BY c_acctbal DESC) r FROM customer) WHERE r <= 25")
def nlargest_all(spark: SparkSession, d: str) -> DataFrame:
    return fr.nlargest(table(spark, d, "customer", "c_custkey", "c_acctbal"), 25, "c_acctbal", "c_custkey", "all")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def nsmallest_first(spark: SparkSession, d: str) -> DataFrame:
    return fr.nlargest(table(spark, d, "customer", "c_custkey", "c_acctbal"), 10, "c_acctbal", "c_custkey", "first", True)


@query("""SELECT p_partkey, p_brand, CAST(rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS r_average, CAST(rank() OVER w AS DOUBLE) AS r_min,
CAST(rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS DOUBLE) AS r_max, CAST(dense_rank() OVER w AS DOUBLE) AS r_dense, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS DOUBLE) AS r_first
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def rank_methods(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    for m in ("average", "min", "max", "dense", "first"):
        p = fr.rank(p, "p_size", m, ["p_brand"], ["p_partkey"], name=f"r_{m}")
    return p.drop("p_size")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem")
def duplicated_flags(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return fr.duplicated(li, ["l_partkey"], ["l_orderkey", "l_linenumber"]).drop("l_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def drop_duplicates_last(spark: SparkSession, d: str) -> DataFrame:
    return fr.drop_duplicates(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "last")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) n FROM orders) WHERE n = 1")
def drop_duplicates_none(spark: SparkSession, d: str) -> DataFrame:
    return fr.drop_duplicates(table(spark, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], False)


@query("""SELECT l_returnflag, round(skewness(l_quantity), 6) AS skew, round(kurtosis(l_quantity), 6) AS kurt, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS sem, round(median(l_quantity), 6) AS median_qty,
round(quantile_cont(l_quantity, 0.9), 6) AS q90, round(var_pop(l_quantity), 5) AS var0, round(covar_samp(l_quantity, l_discount), 6) AS cov FROM lineitem GROUP BY l_returnflag""")
def corrected_moments(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount")
    return li.groupBy("l_returnflag").agg(
        F.round(fr.skew("l_quantity"), 6).alias("skew"), F.round(fr.kurt("l_quantity"), 6).alias("kurt"), F.round(fr.sem("l_quantity"), 8).alias("sem"), F.round(F.median("l_quantity"), 6).alias("median_qty"),
        F.round(F.percentile("l_quantity", F.lit(0.9)), 6).alias("q90"), F.round(F.var_pop("l_quantity"), 5).alias("var0"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cov"),
    )


@query("SELECT p_brand, p_size, n FROM (SELECT p_brand, p_size, count(*) AS n, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) r FROM part GROUP BY 1, 2) WHERE r = 1")
def mode_all_ties(spark: SparkSession, d: str) -> DataFrame:
    return fr.mode(table(spark, d, "part", "p_brand", "p_size"), "p_size", ["p_brand"])


@query("""WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 a,
rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 b FROM customer) SELECT c_mktsegment, round(corr(a, b), 8) AS spearman FROM r GROUP BY 1""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    s = fr.spearman(table(spark, d, "customer", "c_mktsegment", "c_acctbal", "c_nationkey"), "c_acctbal", "c_nationkey", ["c_mktsegment"])
    return s.select("c_mktsegment", F.round("spearman", 8).alias("spearman"))


@query("SELECT o_orderpriority, round(avg(abs(o_totalprice - m)), 4) AS mad FROM orders JOIN (SELECT o_orderpriority p, avg(o_totalprice) m FROM orders GROUP BY 1) ON p = o_orderpriority GROUP BY 1")
def mean_absolute_deviation(spark: SparkSession, d: str) -> DataFrame:
    m = fr.mean_absolute_deviation(table(spark, d, "orders", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"])
    return m.select("o_orderpriority", F.round("mad", 4).alias("mad"))


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    return fr.value_counts(table(spark, d, "events", "event_type"), "event_type", normalize=True)


@query("""WITH x AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS i, 0.37 * (count(*) OVER (PARTITION BY c_mktsegment) - 1) AS pl FROM customer)
SELECT c_mktsegment, max(CASE WHEN i = floor(pl) THEN c_acctbal END) AS q_lower, max(CASE WHEN i = ceil(pl) THEN c_acctbal END) AS q_higher, round(avg(CASE WHEN i IN (floor(pl), ceil(pl)) THEN c_acctbal END), 6) AS q_midpoint FROM x GROUP BY 1""")
def quantile_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_mktsegment", "c_acctbal")
    q = lambda how: fr.quantile(c, "c_acctbal", 0.37, ["c_mktsegment"], how).withColumnRenamed("quantile", f"q_{how}")
    return q("lower").join(q("higher"), "c_mktsegment").join(q("midpoint").withColumn("q_midpoint", F.round("q_midpoint", 6)), "c_mktsegment")


@query("""SELECT o_orderstatus, column_name, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS greatest
FROM (SELECT o_orderstatus, 'o_totalprice' AS column_name, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders) GROUP BY 1, 2""")
def describe_groups(spark: SparkSession, d: str) -> DataFrame:
    g = fr.describe(table(spark, d, "orders", "o_orderstatus", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], ["o_orderstatus"])
    return g.select("o_orderstatus", "column_name", "n", *[F.round(c, 3).alias(c) for c in ("mean", "std")], "least", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "greatest")


@query("""SELECT event_id, user_id, count(value) OVER w AS roll_count, round(sum(value) OVER w, 4) AS roll_sum, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 4) END AS roll_mean, CASE WHEN count(value) OVER w >= 3 THEN round(stddev_samp(value) OVER w, 4) END AS roll_std,
CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END AS roll_max, CASE WHEN count(value) OVER w >= 3 THEN round(median(value) OVER w, 4) END AS roll_median FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    r = fr.rolling(fr.rolling(e, "value", ["ts", "event_id"], ["user_id"], 5, ["count", "sum"], 0), "value", ["ts", "event_id"], ["user_id"], 5, ["mean", "std", "max", "median"], 3)
    return r.select("event_id", "user_id", "roll_count", "roll_max", *[F.round(f"roll_{c}", 4).alias(f"roll_{c}") for c in ("sum", "mean", "std", "median")])


@query("""SELECT event_id, round(sum(value) OVER w, 3) AS roll_sum, round(avg(value) OVER w, 8) AS roll_mean, min(value) OVER w AS roll_min FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def expanding_stats(spark: SparkSession, d: str) -> DataFrame:
    e = fr.rolling(table(spark, d, "events", "event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"], None, ["sum", "mean", "min"])
    return e.select("event_id", F.round("roll_sum", 3).alias("roll_sum"), F.round("roll_mean", 8).alias("roll_mean"), "roll_min")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events),
f AS (SELECT event_id, user_id, n, value AS s, CAST(1.0 AS DOUBLE) AS w FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, f.s * 0.7 + o.value, f.w * 0.7 + 1.0 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id, round(s / w, 4) AS ewm_mean FROM f""")
def ewm_mean(spark: SparkSession, d: str) -> DataFrame:
    e = fr.ewm_mean(table(spark, d, "events", "event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"], 0.3)
    return e.select("event_id", F.round("ewm_mean", 4).alias("ewm_mean"))


@query("""SELECT event_id, round(sum(value) OVER w, 3) AS cum_sum, max(value) OVER w AS cum_max, min(value) OVER w AS cum_min, row_number() OVER w - 1 AS cum_count FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative_stats(spark: SparkSession, d: str) -> DataFrame:
    c = fr.cumulative(table(spark, d, "events", "event_id", "event_type", "ts", "value"), "value", ["ts", "event_id"], ["event_type"], ["sum", "max", "min", "count"])
    return c.select("event_id", F.round("cum_sum", 3).alias("cum_sum"), "cum_max", "cum_min", F.col("cum_count").cast("long").alias("cum_count"))


_GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events"


@query(f"SELECT event_id, coalesce(v, lag(v, 1) OVER w, lag(v, 2) OVER w) AS v FROM ({_GAPS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ffill_limit(spark: SparkSession, d: str) -> DataFrame:
    return fr.ffill(_gaps(spark, d), ["v"], ["ts", "event_id"], ["user_id"], 2).select("event_id", "v")


@query(f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ({_GAPS})")
def bfill(spark: SparkSession, d: str) -> DataFrame:
    return fr.ffill(_gaps(spark, d), ["v"], ["ts", "event_id"], ["user_id"], backward=True).select("event_id", "v")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))


@query(f"""WITH g AS ({_GAPS}), x AS (SELECT event_id, v, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1
FROM g WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 IS NULL THEN v0 WHEN t0 IS NOT NULL THEN v0 + (v1 - v0) * (event_id - t0) / (t1 - t0) END, 8) AS v FROM x""")
def interpolate_linear(spark: SparkSession, d: str) -> DataFrame:
    return fr.interpolate(_gaps(spark, d), "v", "event_id", ["user_id"]).select("event_id", F.round("v", 8).alias("v"))


@query("""SELECT c_mktsegment, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P, round(sum(o_totalprice) FILTER (o_orderstatus IN ('F', 'O', 'P')), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def pivot_table(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return fr.pivot_table(o, ["c_mktsegment"], "o_orderstatus", ["F", "O", "P"], F.round(F.sum("o_totalprice"), 2), margin="total")


@query("SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)")
def melt(spark: SparkSession, d: str) -> DataFrame:
    return fr.melt(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("SELECT event_id, CAST(event_type = 'click' AS INT) AS kind_click, CAST(event_type = 'view' AS INT) AS kind_view FROM events")
def get_dummies(spark: SparkSession, d: str) -> DataFrame:
    return fr.get_dummies(table(spark, d, "events", "event_id", "event_type"), "event_type", ["click", "view"], "kind")


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 25 THEN 1 WHEN p_size > 25 AND p_size <= 40 THEN 2 END AS bin FROM part")
def cut_bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", fr.cut(F.col("p_size"), [0, 10, 25, 40]).alias("bin"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]) e FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= e[2] THEN 0 WHEN c_acctbal <= e[3] THEN 1 WHEN c_acctbal <= e[4] THEN 2 ELSE 3 END AS bin FROM customer, q""")
def qcut_bins(spark: SparkSession, d: str) -> DataFrame:
    return fr.qcut(table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_acctbal", 4).select("c_custkey", "bin")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab_counts(spark: SparkSession, d: str) -> DataFrame:
    return fr.crosstab(table(spark, d, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def margins_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY event_type) f FROM events)")
def factorize(spark: SparkSession, d: str) -> DataFrame:
    return fr.factorize(table(spark, d, "events", "event_id", "event_type"), "event_type", "event_id").select("event_id", F.col("code").cast("long").alias("code"))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = fr.corr_matrix(table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])
    return m.select("a", "b", F.round("corr", 8).alias("corr"))


@query("SELECT k AS nation_key, n_name, r_name, CASE WHEN n_name IS NULL THEN 'right_only' WHEN r_name IS NULL THEN 'left_only' ELSE 'both' END AS merge_side FROM (SELECT n_regionkey + n_nationkey % 3 AS k, n_name FROM nation) FULL JOIN (SELECT r_regionkey + 3 AS k, r_name FROM region) USING (k)")
def merge_indicator(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select((F.col("n_regionkey") + F.col("n_nationkey") % 3).alias("nation_key"), "n_name")
    r = table(spark, d, "region").select((F.col("r_regionkey") + 3).alias("nation_key"), "r_name")
    return joins.merge(n, r, ["nation_key"], "outer", indicator=True, validate="many_to_one")


_BUYS = "(SELECT ts, user_id, event_id AS buy_id FROM events WHERE event_type = 'purchase')"
_VIEWS = "(SELECT ts, user_id, event_id FROM events WHERE event_type = 'view')"


def _views_and_buys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("buy_id"))


@query(f"SELECT v.event_id, b.buy_id FROM {_VIEWS} v ASOF LEFT JOIN {_BUYS} b ON v.user_id = b.user_id AND v.ts >= b.ts")
def merge_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    v, b = _views_and_buys(spark, d)
    return joins.asof(v, b, "ts", ["user_id"], ["buy_id"]).select("event_id", "buy_id")


@query(f"SELECT v.event_id, b.buy_id FROM {_VIEWS} v ASOF LEFT JOIN {_BUYS} b ON v.user_id = b.user_id AND v.ts <= b.ts")
def merge_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    v, b = _views_and_buys(spark, d)
    return joins.asof(v, b, "ts", ["user_id"], ["buy_id"], "forward").select("event_id", "buy_id")


@query(f"""WITH a AS (SELECT v.event_id, v.ts AS t, b.buy_id AS b0, b.ts AS t0 FROM {_VIEWS} v ASOF LEFT JOIN {_BUYS} b ON v.user_id = b.user_id AND v.ts >= b.ts),
f AS (SELECT v.event_id, b.buy_id AS b1, b.ts AS t1 FROM {_VIEWS} v ASOF LEFT JOIN {_BUYS} b ON v.user_id = b.user_id AND v.ts <= b.ts)
SELECT event_id, CASE WHEN t0 IS NULL THEN b1 WHEN t1 IS NULL OR t - t0 <= t1 - t THEN b0 ELSE b1 END AS buy_id FROM a JOIN f USING (event_id)""")
def merge_asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    v, b = _views_and_buys(spark, d)
    return joins.asof(v, b, "ts", ["user_id"], ["buy_id"], "nearest", id_col="event_id").select("event_id", "buy_id")


@query("SELECT k, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM (SELECT coalesce(n_nationkey, r_regionkey * 7) AS k, n_name AS a, r_name AS b FROM nation FULL JOIN region ON n_nationkey = r_regionkey * 7) WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)")
def merge_ordered(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    r = table(spark, d, "region").select((F.col("r_regionkey") * 7).alias("k"), F.col("r_name").alias("b"))
    return joins.ordered_merge(n, r, "k", fill=True)


@query("SELECT date_trunc('day', ts) AS bucket, count(*) AS n, round(sum(value), 3) AS total, max(value) AS greatest FROM events GROUP BY 1")
def resample_daily(spark: SparkSession, d: str) -> DataFrame:
    return fr.resample(table(spark, d, "events", "ts", "value"), "ts", "1 day", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 3), "greatest": F.max("value")})


@query("SELECT event_type, date_trunc('day', ts) AS bucket, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2")
def ohlc(spark: SparkSession, d: str) -> DataFrame:
    return fr.ohlc(table(spark, d, "events", "ts", "value", "event_type"), "ts", "1 day", "value", ["event_type"])


@query("""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM b GROUP BY 1)
SELECT user_id, bucket, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS n FROM s LEFT JOIN b USING (user_id, bucket)""")
def resample_upsample_ffill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "user_id")
    b = fr.resample(e, "ts", "1 hour", {"n": F.count(F.lit(1))}, ["user_id"])
    return fr.ffill(fr.upsample(b, "bucket", "1 hour", ["user_id"]), ["n"], ["bucket"], ["user_id"]).select("user_id", "bucket", "n")


@query("SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') >= '22:30:00' OR strftime(ts, '%H:%M:%S') <= '02:15:00'")
def between_time(spark: SparkSession, d: str) -> DataFrame:
    return fr.between_time(table(spark, d, "events", "event_id", "ts"), "ts", "22:30:00", "02:15:00").select("event_id")


@query("""SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 5 FROM supplier) UNION ALL SELECT 'intersection', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey + 5 FROM supplier)
UNION ALL SELECT 'difference', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey + 5 FROM supplier) UNION ALL SELECT 'symmetric', k FROM ((SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey + 5 FROM supplier) UNION (SELECT s_nationkey + 5 FROM supplier EXCEPT SELECT c_nationkey FROM customer))""")
def index_set_ops(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select((F.col("s_nationkey") + 5).alias("k"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).unionAll(named("intersection", a.intersect(b))).unionAll(named("difference", a.subtract(b))).unionAll(named("symmetric", a.subtract(b).union(b.subtract(a))))


@query("""SELECT k, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY k""")
def concat_counts(spark: SparkSession, d: str) -> DataFrame:
    return fr.concat([table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter(F.col("l_shipdate") <= F.lit("1998-09-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, value - lag(value) OVER w AS diff, round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS pct, lead(value, 2) OVER w AS ahead, row_number() OVER w - 1 AS cumcount, dense_rank() OVER (ORDER BY event_type) - 1 AS ngroup FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def shift_diff(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events", "event_id", "event_type", "ts", "value")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    groups = fr.position(e.select("event_type").distinct(), ["event_type"], "ngroup")
    before = F.lag("value").over(w)
    x = e.select("event_id", "event_type", (F.col("value") - before).alias("diff"), F.round(F.try_divide(F.col("value"), before) - 1, 6).alias("pct"), F.lead("value", 2).over(w).alias("ahead"), (F.row_number().over(w) - 1).cast("long").alias("cumcount"))
    return x.join(F.broadcast(groups), "event_type").select("event_id", "diff", "pct", "ahead", "cumcount", F.col("ngroup").cast("long").alias("ngroup"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS centred FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10")
def group_transform_filter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("centred", F.round(F.col("o_totalprice") - F.avg("o_totalprice").over(w), 7))
    return o.filter("n >= 10").select("o_orderkey", "o_custkey", "centred")


@query("SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3")
def group_head(spark: SparkSession, d: str) -> DataFrame:
    x = fr.position(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "n", ["o_custkey"])
    return x.filter("n < 3").select("o_custkey", "o_orderkey", (F.col("n") + 1).cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS k5 FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events", "event_id", "props").select("event_id", k.alias("k"), (k % 5).alias("k5"))
