"""Queries of the wider data-frame vocabulary: selection by label, values, windows, time, text, reshaping, indexes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstone.functions import dates, text as tx
from quillstone.operators import axes as ax, frame as fr, joins, labels as lb
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


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# -- selection and labels


@query("SELECT o_orderkey AS x_key, round(o_totalprice * 2, 2) AS x_doubled, o_orderstatus AS x_state, 'n' AS x_tag FROM orders")
def assign_rename_prefix(spark: SparkSession, d: str) -> DataFrame:
    """__getitem__, assign, insert, pop, rename, drop, add_prefix, get."""
    o = ax.get(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus", "tag"], "n")
    o = o.withColumn("doubled", F.round(F.col("o_totalprice") * 2, 2)).drop("o_totalprice")
    o = ax.set_names(o, {"o_orderkey": "key", "o_orderstatus": "state"})
    return o.select(*[F.col(c).alias(f"x_{c}") for c in o.columns])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (3, 5, 8) UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey BETWEEN 20 AND 31")
def loc_labels_and_slices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return ax.loc(p, "p_partkey", [3, 5, 8], columns=["p_name", "p_size"]).unionByName(ax.loc(p, "p_partkey", between=(20, 31), columns=["p_name", "p_size"]))


@query("SELECT (SELECT p_name FROM part WHERE p_partkey = 7) AS at_value, (SELECT p_size FROM part ORDER BY p_retailprice, p_partkey LIMIT 1 OFFSET 4) AS iat_value, (SELECT p_size FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1) AS last_value, (SELECT count(*) FROM region) AS squeezed")
def at_iat_squeeze(spark: SparkSession, d: str) -> DataFrame:
    p, o = table(spark, d, "part"), ["p_retailprice", "p_partkey"]
    n = ax.squeeze(table(spark, d, "region").agg(F.count(F.lit(1)).alias("n")))
    return _one(spark, at_value=ax.at(p, {"p_partkey": 7}, "p_name"), iat_value=ax.iat(p, o, 4, "p_size"), last_value=ax.iat(p, o, -1, "p_size"), squeezed=n)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def xs_and_levels(spark: SparkSession, d: str) -> DataFrame:
    """xs, swaplevel, droplevel of a frame indexed by (o_orderstatus, o_orderkey, o_custkey)."""
    o = ax.reorder_levels(table(spark, d, "orders", "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), ["o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"], ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"])
    return ax.xs(ax.droplevel(o, ["o_orderpriority"]), "o_orderstatus", "F")


@query("SELECT s_suppkey AS k, c.column_name, CASE c.column_name WHEN 's_acctbal' THEN s_acctbal ELSE CAST(s_nationkey AS DOUBLE) END AS value FROM supplier, (VALUES (0, 's_acctbal'), (1, 's_nationkey')) c(i, column_name) WHERE s_suppkey % 2 = c.i")
def lookup_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    wanted = s.select("k", F.when(F.col("k") % 2 == 0, "s_acctbal").otherwise("s_nationkey").alias("column_name"))
    return lb.lookup(s, "k", wanted, ["s_acctbal", "s_nationkey"])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross, -l_quantity AS neg, round(sqrt(abs(l_quantity - 25)), 8) AS dist, power(l_quantity, 2) AS squared, l_quantity > 30 AND l_returnflag = 'R' AS flagged FROM lineitem")
def eval_assignments(spark: SparkSession, d: str) -> DataFrame:
    """eval with assignment: binary, unary and mathematical operations, given values."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag")
    x = ax.evaluate(li, "net = l_extendedprice * (1 - l_discount)\ngross = round(net * (1 + l_tax), 7)\nneg = -l_quantity\ndist = round(sqrt(abs(l_quantity - @mid)), 8)\nsquared = l_quantity ** 2\nflagged = l_quantity > 30 and l_returnflag == @flag", {"mid": 25, "flag": "R"})
    return x.select("l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), "gross", "neg", "dist", "squared", "flagged")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_dtypes_and_filter(spark: SparkSession, d: str) -> DataFrame:
    return ax.filter_columns(ax.select_dtypes(table(spark, d, "customer"), "number"), regex="^c_")


@query("SELECT count(*) AS n_rows, 5 AS n_columns, 5 * count(*) AS size, count(*) = 0 AS is_empty, CASE WHEN count(nullif(text, NULL)) < count(*) THEN 'n_chars,owner,text' END AS has_nulls FROM documents")
def frame_facts(spark: SparkSession, d: str) -> DataFrame:
    x = ax.facts(table(spark, d, "documents", "doc_id", "text", "source", "n_chars", "owner"))
    return x.withColumn("has_nulls", F.array_join(F.sort_array("has_nulls"), ","))


@query("SELECT coalesce(c_custkey, s_suppkey) AS k, c_acctbal AS v_x, s_acctbal AS v_y FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE coalesce(c_custkey, s_suppkey) BETWEEN 5 AND 900")
def align_and_truncate(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return lb.truncate(lb.align(a, b, ["k"]), "k", 5, 900)


@query("SELECT CAST(a AS INT) AS a, b, CAST(c AS BOOLEAN) AS c FROM (VALUES (1), (2), (3)) x(a), (VALUES ('u'), ('v')) y(b), (VALUES (true), (false)) z(c)")
def index_from_product(spark: SparkSession, d: str) -> DataFrame:
    return ax.from_product(spark, {"a": [1, 2, 3], "b": ["u", "v"], "c": [True, False]})


@query("SELECT p_partkey AS k, coalesce(pos, -1) AS place FROM part LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier) ON s_suppkey = p_partkey")
def index_get_indexer(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.struct("s_acctbal", "s_suppkey").alias("o"))
    return ax.indexer(table(spark, d, "part").select(F.col("p_partkey").alias("k")), s, "k", "o").select("k", F.col("place").cast("long").alias("place"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 1000) AS start, (SELECT count(*) FROM customer WHERE c_acctbal <= 5000) AS stop")
def index_slice_bounds(spark: SparkSession, d: str) -> DataFrame:
    return ax.slice_bounds(table(spark, d, "customer"), "c_acctbal", 1000, 5000)


@query("WITH p AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), q AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM p WHERE i NOT IN (0, 4)) SELECT n_nationkey, n_name, i + CASE WHEN i >= 3 THEN 1 ELSE 0 END AS place FROM q UNION ALL SELECT 99, 'NEW', 3")
def index_delete_insert(spark: SparkSession, d: str) -> DataFrame:
    n = ax.delete(table(spark, d, "nation", "n_nationkey", "n_name"), ["n_nationkey"], [0, 4])
    return ax.insert(n, ["n_nationkey"], 3, {"n_nationkey": 99, "n_name": "NEW"}).withColumn("place", F.col("place").cast("long"))


@query("SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey, LATERAL (SELECT unnest(generate_series(1, n_regionkey)))")
def repeat_rows(spark: SparkSession, d: str) -> DataFrame:
    """repeat behind a join on an index."""
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return ax.repeat(n, F.col("n_regionkey")).select("n_nationkey", "n_regionkey", "r_name")


@query("SELECT min(event_id) FILTER (event_type = 'purchase') AS first_valid, max(event_id) FILTER (event_type = 'purchase') AS last_valid FROM events")
def first_and_last_valid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type").withColumn("v", F.when(F.col("event_type") == "purchase", 1))
    return ax.first_valid(e, "v", "event_id")


# -- values


@query("SELECT p_partkey, power(p_size, 2) AS squared, power(2, p_size % 8) AS two_to, p_size > 10 AND p_retailprice > 1000 AS both_, p_size > 10 OR p_retailprice > 1000 AS either_, (p_size > 10) <> (p_retailprice > 1000) AS one_, NOT p_size > 10 AS none_, abs(-p_size) AS magnitude, round(p_retailprice, 0) AS rounded, p_size BETWEEN 5 AND 9 AS within, p_size IN (1, 7, 49) AS listed, CASE p_size WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE p_size END AS replaced, CAST(p_size AS VARCHAR) AS as_text FROM part")
def powers_and_logic(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    s, big, dear = F.col("p_size"), F.col("p_size") > 10, F.col("p_retailprice") > 1000
    replaced = p.select("p_partkey", s.alias("replaced")).replace({1: 100, 2: 200}, subset=["replaced"])
    x = p.select("p_partkey", F.pow(s, F.lit(2)).alias("squared"), F.pow(F.lit(2), s % 8).alias("two_to"), (big & dear).alias("both_"), (big | dear).alias("either_"), (big != dear).alias("one_"), (~big).alias("none_"), F.abs(-s).alias("magnitude"), F.round("p_retailprice", 0).alias("rounded"), s.between(5, 9).alias("within"), s.isin(1, 7, 49).alias("listed"), s.cast("string").alias("as_text"))
    return x.join(replaced, "p_partkey")


@query("SELECT doc_id, text IS NULL AS no_text, n_chars IS NOT NULL AS has_n, coalesce(owner, 'nobody') AS owner, coalesce(n_chars, -1) AS n_chars FROM documents WHERE title IS NOT NULL AND (CASE WHEN text IS NULL THEN 0 ELSE 1 END + CASE WHEN n_chars IS NULL THEN 0 ELSE 1 END + CASE WHEN owner IS NULL THEN 0 ELSE 1 END) >= 2")
def missing_values(spark: SparkSession, d: str) -> DataFrame:
    """isna, notna, fillna, dropna(subset), dropna(thresh)."""
    x = table(spark, d, "documents", "doc_id", "text", "n_chars", "owner", "title").dropna(subset=["title"]).dropna(thresh=2, subset=["text", "n_chars", "owner"])
    x = x.withColumn("no_text", F.col("text").isNull()).withColumn("has_n", F.col("n_chars").isNotNull())
    return x.fillna({"owner": "nobody", "n_chars": -1}).select("doc_id", "no_text", "has_n", "owner", "n_chars")


@query("SELECT task_id, reference, row_number() OVER (ORDER BY reference DESC NULLS LAST, task_id) - 1 AS place FROM (SELECT DISTINCT task_id, reference FROM mining_tasks)")
def sort_with_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mining_tasks", "task_id", "reference").distinct()
    top = fr.rank(m, "reference", "dense", ascending=False, name="k").withColumn("k", F.coalesce("k", F.lit(1e18)))
    return fr.position(top, ["k", "task_id"], "place").select("task_id", "reference", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS place FROM events")
def recode_sorted(spark: SparkSession, d: str) -> DataFrame:
    """unique, safe_sort."""
    return ax.recode(table(spark, d, "events", "event_id", "event_type"), "event_type").select("event_id", F.col("place").cast("long").alias("place"))


@query("""SELECT l_returnflag, round(exp(sum(ln(1 + l_tax))), 4) AS prod_tax, round(median(l_quantity), 4) AS median_q, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(DISTINCT l_suppkey) AS n_suppliers, bool_or(l_quantity = 50) AS any_50, bool_and(l_quantity > 0) AS all_positive,
round(covar_samp(l_quantity, l_extendedprice), 3) AS cov_qp, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS sem_q, round(var_samp(l_quantity), 6) AS var_q FROM lineitem GROUP BY 1""")
def reductions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem", "l_returnflag", "l_tax", "l_quantity", "l_shipdate", "l_suppkey", "l_extendedprice").groupBy("l_returnflag")
    q = F.col("l_quantity")
    return g.agg(
        F.round(F.exp(F.sum(F.log(1 + F.col("l_tax")))), 4).alias("prod_tax"), F.round(F.percentile(q, F.lit(0.5)), 4).alias("median_q"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.count_distinct("l_suppkey").alias("n_suppliers"), F.bool_or(q == 50).alias("any_50"), F.bool_and(q > 0).alias("all_positive"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("cov_qp"),
        F.round(fr.sem("l_quantity"), 8).alias("sem_q"), F.round(F.var_samp(q), 6).alias("var_q"),
    )


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS idx_min, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS idx_max, CAST(product(CAST(p_size % 3 + 1 AS DOUBLE)) AS DOUBLE) AS prod_small FROM part WHERE p_partkey <= 400 OR p_partkey > 0 AND p_size = 1 GROUP BY 1")
def idxmin_idxmax_prod(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_brand", "p_partkey", "p_retailprice", "p_size").filter("p_partkey <= 400 or p_partkey > 0 and p_size = 1")
    return p.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("idx_min"), F.max_by("p_partkey", F.struct(F.col("p_retailprice"), -F.col("p_partkey"))).alias("idx_max"), F.product(F.col("p_size") % 3 + 1).alias("prod_small"))


@query("SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.v, 0), coalesce(b.v, 0)) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) b ON a.k = b.k")
def combine_by_function(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return ax.combine(a, b, ["k"], F.greatest, 0.0)


@query("SELECT 'l_extendedprice' AS column_name, round(corr(l_extendedprice, l_quantity), 8) AS corr FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_quantity), 8) FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_tax, l_quantity), 8) FROM lineitem")
def correlation_with_column(spark: SparkSession, d: str) -> DataFrame:
    return ax.corrwith(table(spark, d, "lineitem"), ["l_extendedprice", "l_discount", "l_tax"], "l_quantity").withColumn("corr", F.round("corr", 8))


@query("SELECT event_id, CAST(event_id AS BIGINT) AS as_int, CAST(event_id AS DOUBLE) / 2 AS as_double, event_id % 2 = 0 AS as_bool, ts AS as_time, event_type AS as_text FROM events")
def converted_types(spark: SparkSession, d: str) -> DataFrame:
    """convert_dtypes, infer_objects, to_numeric, to_datetime over columns of text."""
    e = table(spark, d, "events", "event_id", "ts", "event_type")
    t = e.select("event_id", F.col("event_id").cast("string").alias("as_int"), (F.col("event_id") / 2).cast("string").alias("as_double"), (F.col("event_id") % 2 == 0).cast("string").alias("as_bool"), F.col("ts").cast("string").alias("as_time"), F.col("event_type").alias("as_text"))
    return ax.convert_types(t)


@query("SELECT p_partkey, upper(p_brand) AS p_brand, p_size * 2 + 1 AS p_size FROM part")
def apply_and_pipe(spark: SparkSession, d: str) -> DataFrame:
    """pipe of functions of a frame; a function of every cell of a kind."""
    step = lambda f, by: f.withColumn("p_size", F.col("p_size") * by)
    return table(spark, d, "part", "p_partkey", "p_brand", "p_size").transform(step, 2).transform(lambda f: f.withColumns({"p_brand": F.upper("p_brand"), "p_size": F.col("p_size") + 1}))


@query("SELECT c_nationkey, c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS centred FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) >= 10")
def group_apply_filter(spark: SparkSession, d: str) -> DataFrame:
    """GroupBy.apply by a pandas function, filter by an aggregate."""
    c = ax.group_filter(table(spark, d, "customer", "c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.count(F.lit(1)), lambda n: n >= 10)
    return ax.group_apply(c, ["c_nationkey"], lambda g: g.assign(centred=(g.c_acctbal - g.c_acctbal.mean()).round(4))[["c_nationkey", "c_custkey", "centred"]], "c_nationkey int, c_custkey long, centred double")


@query("SELECT o_orderpriority, date_trunc('month', o_orderdate) AS bucket, count(*) AS n, bool_or(o_orderstatus = 'P') AS any_open, bool_and(o_totalprice > 0) AS all_paid, round(stddev_samp(o_totalprice), 4) AS std_price, round(var_samp(o_totalprice), 0) AS var_price, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1, 2")
def grouper_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Grouper and TimeGrouper beside a column, NamedAgg, any, all, std, var."""
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").isNotNull())
    g = o.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("bucket"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"), F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std_price"), F.round(F.var_samp("o_totalprice"), 0).alias("var_price"), F.count_distinct("o_custkey").alias("n_customers"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2")
def group_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").dropna(subset=["c_nationkey", "c_mktsegment"]).groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# -- windows


@query("""SELECT event_id, n AS roll_count, round(s, 4) AS roll_sum, round(m, 8) AS roll_mean, lo AS roll_min, hi AS roll_max FROM (SELECT *, count(value) OVER w AS n, sum(value) OVER w AS s, avg(value) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECOND PRECEDING AND CURRENT ROW))""")
def rolling_by_time(spark: SparkSession, d: str) -> DataFrame:
    x = fr.rolling_time(table(spark, d, "events", "event_id", "user_id", "ts", "value"), "value", "ts", ["user_id"], 21_600, ["count", "sum", "mean", "min", "max"])
    return x.select("event_id", "roll_count", F.round("roll_sum", 4).alias("roll_sum"), F.round("roll_mean", 8).alias("roll_mean"), "roll_min", "roll_max")


@query("""SELECT event_id, CASE WHEN n >= 5 THEN round(cv, 5) END AS roll_cov, CASE WHEN n >= 5 AND isfinite(cr) THEN round(cr, 7) END AS roll_corr FROM (SELECT event_id, count(value) OVER w AS n, covar_samp(value, x) OVER w AS cv, corr(value, x) OVER w AS cr FROM (SELECT *, CAST(event_id % 17 AS DOUBLE) AS x FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def rolling_cov_corr(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "value").withColumn("x", (F.col("event_id") % 17).cast("double"))
    return fr.rolling_pair(e, "value", "x", ["event_id"], ["user_id"], 5).select("event_id", F.round("roll_cov", 5).alias("roll_cov"), F.round("roll_corr", 7).alias("roll_corr"))


@query("""SELECT event_id, round(q, 6) AS q75, round(a, 6) AS spread, round(f, 6) AS ahead, round(c, 6) AS centred FROM (SELECT event_id, quantile_cont(value, 0.75) OVER w AS q, CASE WHEN count(value) OVER w >= 4 THEN max(value) OVER w - min(value) OVER w END AS a,
sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS f, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""")
def rolling_bounds_and_apply(spark: SparkSession, d: str) -> DataFrame:
    """Moving quantile, a function of the window's values, forward-looking and centred window bounds."""
    o, by = ["event_id"], ["user_id"]
    e = fr.rolling_apply(table(spark, d, "events", "event_id", "user_id", "value"), "value", o, by, 4, lambda x: F.array_max(x) - F.array_min(x), "spread")
    e = fr.rolling_bounds(e, o, by, -3, 0, {"q75": lambda w: F.percentile("value", F.lit(0.75)).over(w)})
    e = fr.rolling_bounds(e, o, by, 0, 2, {"ahead": lambda w: F.sum("value").over(w)})
    e = fr.rolling_bounds(e, o, by, -1, 1, {"centred": lambda w: F.avg("value").over(w)})
    return e.select("event_id", *[F.round(c, 6).alias(c) for c in ("q75", "spread", "ahead", "centred")])


_EWM = """WITH e AS (SELECT user_id, event_id, value AS x, CAST(event_id % 17 AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
p AS (SELECT a.event_id, sum(w) AS s1, sum(w * w) AS s2, sum(w * b.x) / sum(w) AS mx, sum(w * b.y) / sum(w) AS my, sum(w * b.x * b.x) / sum(w) AS xx, sum(w * b.y * b.y) / sum(w) AS yy, sum(w * b.x * b.y) / sum(w) AS xy FROM
(SELECT a.user_id, a.event_id, a.i, b.x, b.y, power(0.75, a.i - b.i) AS w FROM e a JOIN e b ON a.user_id = b.user_id AND b.i <= a.i) b JOIN e a ON a.event_id = b.event_id GROUP BY 1),
f AS (SELECT *, CASE WHEN s1 * s1 - s2 > 1e-9 THEN s1 * s1 / (s1 * s1 - s2) END AS bias FROM p) """


@query(_EWM + "SELECT event_id, round(mx, 8) AS ewm_mean, round(bias * (xx - mx * mx), 7) AS ewm_var, CASE WHEN bias IS NOT NULL THEN round(sqrt(greatest(bias * (xx - mx * mx), 0)), 6) END AS ewm_std FROM f")
def ewm_moments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "value")
    x = fr.ewm(e, ["value"], ["event_id"], ["user_id"], fr.ewm_alpha(com=3), ["mean", "var", "std"])
    return x.select("event_id", F.round("ewm_mean", 8).alias("ewm_mean"), F.round("ewm_var", 7).alias("ewm_var"), F.round("ewm_std", 6).alias("ewm_std"))


@query(_EWM + "SELECT event_id, round(bias * (xy - mx * my), 6) AS ewm_cov, CASE WHEN bias IS NOT NULL AND (xx - mx * mx) * (yy - my * my) > 1e-9 THEN round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 5) END AS ewm_corr FROM f")
def ewm_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "value").withColumn("y", (F.col("event_id") % 17).cast("double"))
    x = fr.ewm(e, ["value", "y"], ["event_id"], ["user_id"], fr.ewm_alpha(span=7), ["cov", "corr"])
    return x.select("event_id", F.round("ewm_cov", 6).alias("ewm_cov"), F.round("ewm_corr", 5).alias("ewm_corr"))


@query("SELECT c_custkey, CAST(rank() OVER (ORDER BY c_mktsegment) + (count(*) OVER (PARTITION BY c_mktsegment) - 1) / 2.0 AS DOUBLE) AS r_average, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS DOUBLE) AS r_dense, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS DOUBLE) AS r_first, round(rank() OVER (ORDER BY c_mktsegment) / count(*) OVER (), 9) AS r_share FROM customer")
def global_ranks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    for m in ("average", "dense", "first"):
        c = fr.rank(c, "c_mktsegment", m, tie=["c_custkey"], name=f"r_{m}")
    return fr.rank(c, "c_mktsegment", "min", pct=True, name="r_share").withColumn("r_share", F.round("r_share", 9)).drop("c_mktsegment")


# -- time


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2000-01-01 06:00:00') + INTERVAL 1 DAY AS bucket, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def resample_right_offset(spark: SparkSession, d: str) -> DataFrame:
    """Buckets closed and labelled on the right, moved by six hours."""
    e = table(spark, d, "events", "ts", "value", "event_type")
    return fr.resample(e, "ts", "1 day", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 3)}, ["event_type"], "right", "right", "6 hours")


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY event_type, date_trunc('hour', ts)), 8) AS share, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS turn FROM events")
def resample_transform(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "value", "event_type")
    x = fr.resample_transform(e, "ts", "1 hour", {"share": lambda w: F.round(F.col("value") / F.sum("value").over(w), 8), "turn": lambda w: F.row_number().over(w.orderBy("event_id"))}, ["event_type"])
    return x.select("event_id", "share", F.col("turn").cast("long").alias("turn"))


@query("""WITH a AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(t) FROM a), (SELECT max(t) FROM a), INTERVAL 20 MINUTE)) AS t),
j AS (SELECT s.t, a.v FROM s LEFT JOIN a USING (t)), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0, last_value(v IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1, first_value(v IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM j)
SELECT t, round(v, 8) AS as_is, round(coalesce(v, v0 + (v1 - v0) * epoch(t - t0) / epoch(t1 - t0)), 8) AS filled FROM k""")
def asfreq_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """asfreq to twenty minutes, missing values by linear interpolation."""
    hourly = fr.resample(table(spark, d, "events", "ts", "value"), "ts", "1 hour", {"v": F.avg("value")}).withColumnRenamed("bucket", "at")
    x = fr.upsample(hourly, "at", "20 MINUTE").withColumn("s", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("as_is", F.col("v")).withColumn("g", F.lit(0))
    return fr.interpolate(x, "v", "s", ["g"]).select(F.col("at").alias("t"), F.round("as_is", 8).alias("as_is"), F.round("v", 8).alias("filled"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_of, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || quarter(o_orderdate) AS quarter_of, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_starts, o_orderdate + INTERVAL 9 HOUR AS tokyo, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%H:%M:%S') AS clock,
year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS leap, 0 AS nanos, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS quarter_ends FROM orders""")
def periods_and_zones(spark: SparkSession, d: str) -> DataFrame:
    """to_period, to_timestamp, tz_localize, tz_convert, date, time, is_leap_year, nanosecond."""
    o, t = table(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("o_orderdate")
    tokyo = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), t)
    leap = F.month(F.date_add(F.make_date(F.year(t), F.lit(2), F.lit(28)), 1)) == 2
    ends = F.date_sub(F.add_months(F.trunc(F.to_date(t), "quarter"), 3), 1)
    return o.select("o_orderkey", dates.period(t, "month").alias("month_of"), dates.period(t, "quarter").alias("quarter_of"), F.trunc(F.to_date(t), "month").alias("month_starts"), tokyo.alias("tokyo"), F.to_date(t).alias("day"), F.date_format(t, "HH:mm:ss").alias("clock"), leap.alias("leap"), F.lit(0).alias("nanos"), ends.alias("quarter_ends"))


@query("""SELECT d, CAST(last_day(d + INTERVAL 1 DAY) AS DATE) AS month_end, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS month_begin, CAST(date_trunc('quarter', d + INTERVAL 1 DAY) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CAST(date_trunc('year', d) + INTERVAL 1 YEAR AS DATE) AS year_begin,
CAST(date_trunc('week', d + INTERVAL 1 DAY) + INTERVAL 6 DAY AS DATE) AS week_end, CAST(CASE WHEN day(d) < 15 THEN date_trunc('month', d) + INTERVAL 14 DAY WHEN d < last_day(d) THEN last_day(d) ELSE d + INTERVAL 15 DAY END AS DATE) AS semi_end FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def anchored_offsets(spark: SparkSession, d: str) -> DataFrame:
    """MonthEnd, MonthBegin, QuarterEnd, YearBegin, Week and SemiMonthEnd."""
    x, c = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct(), F.col("d")
    e = dates.period_edge
    return x.select("d", e(c, "month").alias("month_end"), e(c, "month", end=False).alias("month_begin"), e(c, "quarter").alias("quarter_end"), e(c, "year", end=False).alias("year_begin"), e(c, "week").alias("week_end"), dates.semi_month_end(c).alias("semi_end"))


_DAYS = {2023: [(1, 2), (1, 16), (2, 20), (5, 29), (6, 19), (7, 4), (9, 4), (10, 9), (11, 10), (11, 23), (12, 25)], 2024: [(1, 1), (1, 15), (2, 19), (5, 27), (6, 19), (7, 4), (9, 2), (10, 14), (11, 11), (11, 28), (12, 25)]}
_EASTER = {1995: (4, 16), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2038: (4, 25)}


@query("SELECT * FROM (VALUES " + ", ".join(f"({y}, DATE '{date(y, m, k)}')" for y, x in _DAYS.items() for m, k in x) + ") t(year, holiday)")
def federal_holiday_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The calendars as published for two years are the expected rows."""
    y = spark.createDataFrame([(x,) for x in _DAYS], "year int")
    return y.select("year", F.explode(dates.federal_holidays(F.col("year"))).alias("holiday"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({y}, DATE '{date(y, *x)}')" for y, x in _EASTER.items()) + ") t(year, easter)")
def easter_dates(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(y,) for y in _EASTER], "year int").select("year", dates.easter(F.col("year")).alias("easter"))


@query("SELECT y AS year, CAST(max(day) FILTER (isodow(day) = 6 AND month(day) = 8) AS DATE) AS last_saturday, CAST(arg_min(day, abs(date_diff('day', day, make_date(y, 8, 31)))) FILTER (isodow(day) = 6) AS DATE) AS nearest_saturday FROM (SELECT y, unnest(generate_series(make_date(y, 8, 1), make_date(y, 9, 10), INTERVAL 1 DAY)) AS day FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders)) GROUP BY 1")
def fiscal_year_ends(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", dates.fiscal_year_end(F.col("year"), 8, 5).alias("last_saturday"), dates.fiscal_year_end(F.col("year"), 8, 5, True).alias("nearest_saturday"))


@query("SELECT event_id, CAST(event_id % 4 AS DOUBLE) * 86400 + (event_id % 23) * 3600 + (event_id % 59) * 60 + 7.5 AS seconds, lpad(CAST(event_id % 12 + 12 AS VARCHAR), 2, '0') || ':05:00' AS clock FROM events")
def parsed_durations(spark: SparkSession, d: str) -> DataFrame:
    """to_timedelta and to_time of texts."""
    e, i = table(spark, d, "events", "event_id"), F.col("event_id")
    text = F.concat((i % 4).cast("string"), F.lit(" days "), F.lpad((i % 23).cast("string"), 2, "0"), F.lit(":"), F.lpad((i % 59).cast("string"), 2, "0"), F.lit(":07.5"))
    hour = F.concat(F.when(i % 12 == 0, 12).otherwise(i % 12).cast("string"), F.lit(":05 pm"))
    return e.select("event_id", dates.seconds_of(text).alias("seconds"), dates.time_of(hour).alias("clock"))


@query("SELECT CAST(i AS DOUBLE) * 5400 AS seconds FROM range(0, 17) r(i)")
def timedelta_steps(spark: SparkSession, d: str) -> DataFrame:
    return lb.timedelta_range(spark, 0, 86_400, 5_400)


@query("SELECT CAST(year(s) AS VARCHAR) || 'Q' || quarter(s) AS period, CAST(s AS DATE) AS starts, CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ends FROM (SELECT unnest(generate_series(TIMESTAMP '2021-01-01', TIMESTAMP '2023-07-01', INTERVAL 3 MONTH)) AS s)")
def period_steps(spark: SparkSession, d: str) -> DataFrame:
    return lb.period_range(spark, "2021-02-11", "2023-09-30", "quarter")


@query("SELECT CAST(i * 2.5 AS DOUBLE) AS left_, CAST((i + 1) * 2.5 AS DOUBLE) AS right_, CAST(i * 2.5 + 1.25 AS DOUBLE) AS mid, CAST(2.5 AS DOUBLE) AS length, false AS is_empty FROM range(0, 8) r(i)")
def interval_steps(spark: SparkSession, d: str) -> DataFrame:
    x = lb.interval_range(spark, 0.0, 20.0, 2.5)
    return x.select(F.col("left").alias("left_"), F.col("right").alias("right_"), *[c.alias(n) for n, c in lb.interval_facts(F.col("left"), F.col("right")).items()])


@query("SELECT 3600 AS every_hour, CAST(NULL AS INT) AS of_events")
def inferred_frequency(spark: SparkSession, d: str) -> DataFrame:
    hours = lb.date_range(spark, "2024-01-01", "2024-01-09", "1 HOUR")
    got = lb.infer_frequency(table(spark, d, "events", "ts"), "ts")
    return spark.range(1).select(F.lit(lb.infer_frequency(hours, "ts")).alias("every_hour"), F.lit(got).cast("int").alias("of_events"))


@query("SELECT event_id, ts + INTERVAL 3 DAY AS ts, value FROM events")
def shifted_times(spark: SparkSession, d: str) -> DataFrame:
    """tshift."""
    return ax.shift_times(table(spark, d, "events", "event_id", "ts", "value"), "ts", "1 DAY", 3)


# -- text


@query("""SELECT p_partkey, p_name[1:2] || '#' || p_name[5:] AS replaced_slice, replace(p_type, 'A', 'aa') AS replaced, repeat(left(p_brand, 2), 3) AS repeated, trim(' ' || p_name || ' ') AS stripped, ltrim(' ' || p_name || ' ') AS left_stripped, rtrim('xx' || p_name || 'xx', 'x') AS right_stripped, translate(p_type, 'AEI', '431') AS translated,
starts_with(p_type, 'S') AS starts, suffix(p_type, 'L') AS ends, length(p_name) AS n, lower(p_type) AS low, upper(p_name) AS up, len(regexp_extract_all(p_type, '[AEIOU]')) AS vowels, array_to_string(regexp_extract_all(p_type, '[A-Z]+'), '-') AS joined, p_brand || '/' || coalesce(CASE WHEN p_size > 10 THEN p_type END, 'none') AS cat FROM part""")
def text_edits(spark: SparkSession, d: str) -> DataFrame:
    """slice_replace, replace, repeat, strip, translate, startswith, endswith, len, lower, upper, findall, join, cat."""
    p, name, kind = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size"), F.col("p_name"), F.col("p_type")
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return p.select(
        "p_partkey", F.concat(F.substring(name, 1, 2), F.lit("#"), F.substring(name, 5, 1_000_000)).alias("replaced_slice"), F.replace(kind, F.lit("A"), F.lit("aa")).alias("replaced"), F.repeat(F.substring("p_brand", 1, 2), 3).alias("repeated"), F.trim(padded).alias("stripped"),
        F.ltrim(padded).alias("left_stripped"), F.rtrim(F.concat(F.lit("xx"), name, F.lit("xx")), F.lit("x")).alias("right_stripped"), F.translate(kind, "AEI", "431").alias("translated"), kind.startswith("S").alias("starts"), kind.endswith("L").alias("ends"), F.length(name).cast("long").alias("n"),
        F.lower(kind).alias("low"), F.upper(name).alias("up"), F.size(F.regexp_extract_all(kind, F.lit("[AEIOU]"), F.lit(0))).cast("long").alias("vowels"), F.array_join(F.regexp_extract_all(kind, F.lit("[A-Z]+"), F.lit(0)), "-").alias("joined"),
        tx.cat([F.col("p_brand"), F.when(F.col("p_size") > 10, kind)], "/", "none").alias("cat"),
    )


@query("SELECT p_partkey, CAST(unnest(generate_series(0, len(m) - 1)) AS INT) AS match, unnest(m) AS word FROM (SELECT p_partkey, regexp_extract_all(p_type, '[A-Z]+') AS m FROM part)")
def text_extractall(spark: SparkSession, d: str) -> DataFrame:
    return tx.extractall(table(spark, d, "part", "p_partkey", "p_type"), "p_type", "([A-Z]+)", "match", "word").select("p_partkey", "match", "word")


@query("SELECT p_partkey, upper(left(p_type, 1)) || lower(p_type[2:]) AS capital, array_to_string([upper(left(w, 1)) || lower(w[2:]) FOR w IN string_split(p_type, ' ')], ' ') AS titled, CAST(encode(p_name) AS VARCHAR) AS bytes_, CASE WHEN contains(p_type, ' ') THEN array_to_string(string_split(p_type, ' ')[1:len(string_split(p_type, ' ')) - 1], ' ') ELSE p_type END AS head, CASE WHEN contains(p_type, ' ') THEN string_split(p_type, ' ')[-1] END AS tail, CAST(contains(p_type, 'TIN') AS INT) AS TIN, CAST(contains(p_type, 'BRASS') AS INT) AS BRASS FROM part")
def text_case_and_parts(spark: SparkSession, d: str) -> DataFrame:
    """capitalize, title, encode and decode, rsplit, get_dummies of texts."""
    p, kind = table(spark, d, "part", "p_partkey", "p_name", "p_type"), F.col("p_type")
    parts = tx.rsplit(kind, " ", 1)
    x = tx.dummies(p.withColumn("kind", kind), "kind", ["TIN", "BRASS"], " ")
    return x.select("p_partkey", tx.capitalize(kind).alias("capital"), F.initcap(F.lower(kind)).alias("titled"), F.decode(F.encode("p_name", "UTF-8"), "UTF-8").alias("bytes_"), F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("tail"), F.col("TIN").cast("int").alias("TIN"), F.col("BRASS").cast("int").alias("BRASS"))


# -- reshaping


@query("SELECT s_suppkey, 'a' AS level_0, 'x' AS level_1, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'a', 'y', s_acctbal * 2 FROM supplier UNION ALL SELECT s_suppkey, 'b', 'x', s_acctbal * 3 FROM supplier WHERE s_suppkey % 2 = 0")
def stack_two_levels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_suppkey", "s_acctbal")
    wide = s.select("s_suppkey", F.col("s_acctbal").alias("a_x"), (F.col("s_acctbal") * 2).alias("a_y"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") * 3).alias("b_x"))
    return ax.stack_levels(wide, ["s_suppkey"])


@query("SELECT o_custkey, max(n) FILTER (s = 'F') AS F, max(n) FILTER (s = 'O') AS O, max(n) FILTER (s = 'P') AS P FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def unstack_counts(spark: SparkSession, d: str) -> DataFrame:
    """unstack and pivot of a two-level index."""
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return ax.unstack(n, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "n")


@query("SELECT n_nationkey, r.i AS j, n_regionkey * 10 + r.i AS v FROM nation, (VALUES (1), (2), (3)) r(i)")
def wide_to_long_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", *[(F.col("n_regionkey") * 10 + i).alias(f"v_{i}") for i in (1, 2, 3)])
    return fr.wide_to_long(n, "v", ["n_nationkey"]).select("n_nationkey", F.col("j").cast("int").alias("j"), "v")


@query("SELECT n_nationkey, n_regionkey AS a, n_nationkey * 2 AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey + 100, n_nationkey * 3 FROM nation WHERE n_nationkey % 2 = 0")
def lreshape_groups(spark: SparkSession, d: str) -> DataFrame:
    n, r, k = table(spark, d, "nation"), F.col("n_regionkey"), F.col("n_nationkey")
    wide = n.select(k, r.alias("a1"), (r + 100).alias("a2"), (k * 2).alias("b1"), F.when(k % 2 == 0, k * 3).alias("b2"))
    return lb.lreshape(wide, {"a": ["a1", "a2"], "b": ["b1", "b2"]}, ["n_nationkey"])


@query("SELECT c AS column_name, max(v) FILTER (r = 0) AS k0, max(v) FILTER (r = 1) AS k1, max(v) FILTER (r = 2) AS k2, max(v) FILTER (r = 3) AS k3, max(v) FILTER (r = 4) AS k4 FROM (SELECT r_regionkey AS r, 'n_first' AS c, CAST((SELECT min(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS BIGINT) AS v FROM region UNION ALL SELECT r_regionkey, 'n_nations', (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region) GROUP BY 1")
def transposed_facts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").cast("long").alias("n_first"), F.count(F.lit(1)).alias("n_nations")).withColumn("n_regionkey", F.concat(F.lit("k"), F.col("n_regionkey")))
    return fr.transpose(n, "n_regionkey").withColumnRenamed("key", "column_name")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS k, c.n AS c_n, s.n AS s_n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def concat_by_columns(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return fr.concat_columns([count("customer", "c_nationkey"), count("supplier", "s_nationkey")], ["k"], ["c", "s"])


@query("""WITH x AS (SELECT o_orderpriority AS p, o_orderstatus AS s FROM orders) SELECT p AS o_orderpriority, count(*) FILTER (s = 'F') AS F, count(*) FILTER (s = 'O') AS O, count(*) FILTER (s = 'P') AS P, count(*) AS "All" FROM x GROUP BY 1 UNION ALL SELECT 'All', count(*) FILTER (s = 'F'), count(*) FILTER (s = 'O'), count(*) FILTER (s = 'P'), count(*) FROM x""")
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    return fr.crosstab(table(spark, d, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], margins=True)


@query("SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS F, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 9) AS O, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 9) AS P FROM orders GROUP BY 1")
def crosstab_row_shares(spark: SparkSession, d: str) -> DataFrame:
    x = fr.crosstab(table(spark, d, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "index")
    return x.select("o_orderpriority", *[F.round(c, 9).alias(c) for c in ("F", "O", "P")])


@query("SELECT r_regionkey AS a, n_nationkey AS b FROM region, nation")
def cartesian_pairs(spark: SparkSession, d: str) -> DataFrame:
    """cartesian_product of two small dimensions, by the labels of one as an array."""
    regions = [r[0] for r in table(spark, d, "region", "r_regionkey").collect()]  # five
    return table(spark, d, "nation").select(F.explode(F.array(*[F.lit(x) for x in regions])).alias("a"), F.col("n_nationkey").alias("b"))


# -- categories


@query("SELECT label, code, (SELECT count(*) FROM orders WHERE o_orderpriority = label) AS n FROM (VALUES ('5-LOW', 0), ('1-URGENT', 1), ('9-NEVER', 2)) t(label, code)")
def categories_set(spark: SparkSession, d: str) -> DataFrame:
    """set_categories: reordered, one added, the others removed; counts with unobserved ones."""
    o = table(spark, d, "orders", "o_orderpriority")
    dim = lb.set_categories(lb.categories(o, "o_orderpriority"), ["5-LOW", "1-URGENT", "9-NEVER"])
    return lb.category_counts(o, "o_orderpriority", dim).join(dim, "label").select("label", F.col("code").cast("int").alias("code"), "n")


@query("SELECT '5-LOW' AS least, '1-URGENT' AS greatest")
def categories_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest category of an ordered dtype, unused ones removed."""
    o = table(spark, d, "orders", "o_orderpriority")
    dim = lb.set_categories(lb.categories(o, "o_orderpriority"), ["9-NEVER", "5-LOW", "3-MEDIUM", "1-URGENT"])
    return lb.category_bounds(o, "o_orderpriority", lb.remove_unused(dim, o, "o_orderpriority"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN -1.0 ELSE s_acctbal END AS masked, CASE WHEN s_nationkey IN (1, 2, 3) THEN 'near' ELSE 'far' END AS mapped FROM supplier")
def index_putmask_map(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", fr.where(F.col("s_acctbal"), ~(F.col("s_acctbal") > 5000), -1.0).alias("masked"), F.when(F.col("s_nationkey").isin(1, 2, 3), "near").otherwise("far").alias("mapped"))


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_hashes FROM lineitem")
def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """hash_pandas_object: equal rows have equal hashes; different ones, here, different hashes."""
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    h = x.select(F.xxhash64("l_orderkey", "l_linenumber").alias("h"))
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("n_hashes"))
