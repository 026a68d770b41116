"""Queries of string, date and code functions and of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.functions import code, dates, text
from quillstone.operators.resilient import resilient_map
from quillstone.session import scratch_dir
from quillstone.sources.tables import table
from quillstone.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS head, p_type[-3:] AS tail, instr(p_type, 'A') - 1 AS first_a, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END AS padded, replace(p_type, 'O', '0') AS replaced,
upper(p_type[1]) || lower(p_type[2:]) AS capital, regexp_matches(p_type, '^[A-Z ]+$') AS is_upper, len(regexp_extract_all(p_type, '[AEIOU]')) AS vowels, nullif(regexp_extract(p_brand, '#([0-9])', 1), '') AS digit, length(p_name) AS n_chars, starts_with(p_name, 'P') AS starts FROM part""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    t, b, n = F.col("p_type"), F.col("p_brand"), F.col("p_name")
    return table(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_name").select(
        "p_partkey", F.get(text.split_words(t), F.lit(0)).alias("head"), text.slice_text(t, -3).alias("tail"), text.find(t, "A").cast("long").alias("first_a"), text.pad(b, 12, "left", "*").alias("padded"), F.replace(t, F.lit("O"), F.lit("0")).alias("replaced"),
        text.capitalize(t).alias("capital"), text.match(t, "[A-Z ]+$").alias("is_upper"), F.regexp_count(t, F.lit("[AEIOU]")).cast("long").alias("vowels"), text.extract(b, "#([0-9])").alias("digit"), F.length(n).cast("long").alias("n_chars"), F.startswith(n, F.lit("P")).alias("starts"),
    )


@query("""SELECT task_id, path[1:instr(path, '/') - 1] AS folder, regexp_extract(path, '([^/]*)$', 1) AS leaf, contains(lower(path), '.ipynb') AS is_notebook, coalesce(contains(reference, 'example'), false) AS has_reference FROM (SELECT DISTINCT task_id, path, reference FROM mining_tasks) WHERE contains(path, '/')""")
def string_partition(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mining_tasks", "task_id", "path", "reference").distinct().filter(F.contains("path", F.lit("/")))
    p = F.col("path")
    return t.select("task_id", text.partition(p, "/")["head"].alias("folder"), text.rpartition(p, "/")["tail"].alias("leaf"), text.contains(F.lower(p), ".ipynb", False).alias("is_notebook"), text.contains(F.col("reference"), "example", False).alias("has_reference"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(weekofyear(o_orderdate) AS INT) AS week, CAST(isodow(o_orderdate) - 1 AS INT) AS dayofweek, CAST(dayofyear(o_orderdate) AS INT) AS dayofyear, CAST(quarter(o_orderdate) AS INT) AS quarter,
CAST(day(last_day(o_orderdate)) AS INT) AS days_in_month, day(o_orderdate) = 1 AS is_month_start, CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS is_month_end, strftime(o_orderdate, '%Y/%m/%d %H') AS shown, monthname(o_orderdate) AS month_name, date_trunc('month', o_orderdate) AS month_floor FROM orders""")
def dt_components(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderdate")
    p, f = dates.parts(c), dates.flags(c)
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", *[p[k].alias(k) for k in ("year", "month", "week", "dayofweek", "dayofyear", "quarter", "days_in_month")], f["is_month_start"].alias("is_month_start"), f["is_month_end"].alias("is_month_end"),
        dates.strftime(c, "%Y/%m/%d %H").alias("shown"), F.date_format(c, "MMMM").alias("month_name"), F.date_trunc("month", c).cast("timestamp_ntz").alias("month_floor"),
    )


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS floor15, ts + INTERVAL 90 MINUTE AS later, CAST(last_day(ts) AS DATE) AS month_last FROM events")
def dt_rounding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts").select("event_id", dates.floor_to(F.col("ts"), 900).alias("floor15"), (F.col("ts") + F.expr("INTERVAL 90 MINUTE")).alias("later"), F.last_day("ts").alias("month_last"))


@query("SELECT o_orderkey, CAST((SELECT count(*) FROM range(0, 10) r(i) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(i AS INT)) < 6) AS INT) AS business_days FROM orders")
def business_days(spark: SparkSession, d: str) -> DataFrame:
    c = F.to_date("o_orderdate")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.size(dates.business_days(c, F.date_add(c, 9))).alias("business_days"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "autodoc_results", "rec_id", "code").filter(F.col("code").isNotNull()).dropDuplicates(["rec_id"])


@query()
def code_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select("rec_id", code.udf(code.normal_form)("code").alias("normal"), code.udf(code.sort_keywords)("code").alias("sorted"))


@query()
def code_templates(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def one(s):
        return s.map(lambda c: None if c is None else (code.template(c, ["df"]) or (None,))[0])

    return _codes(spark, d).select("rec_id", one("code").alias("template"))


@query()
def ast_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = code.exploded(_codes(spark, d), "rec_id", "code", code.ast_nodes, code.NODES)
    return n.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


@query()
def definitions_and_uses(spark: SparkSession, d: str) -> DataFrame:
    return code.exploded(_codes(spark, d), "rec_id", "code", code.definitions_and_uses, code.USES)


@query()
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "autodoc_results", "rec_id", "code", "template").dropDuplicates(["rec_id"])
    return t.select("rec_id", code.udf(code.line_diff)("code", "template").alias("diff"))


@query()
def unify_templates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stored template has the shape of its code, with its placeholders bound alike everywhere."""
    import re

    def fits(t: str, c: str) -> bool:
        return code.unify(t, c, sorted(set(re.findall(r"\bCOL\d+\b", t)))) is not None

    t = table(spark, d, "autodoc_results", "rec_id", "code", "template").dropDuplicates(["rec_id"])
    return t.select("rec_id", code.udf(fits, "boolean")("template", "code").alias("fits"))


@query()
def imported_packages(spark: SparkSession, d: str) -> DataFrame:
    p = _codes(spark, d).select("rec_id", code.udf(code.imported_packages, "array<string>")("code").alias("p"))
    return p.select(F.explode("p").alias("package")).groupBy("package").agg(F.count(F.lit(1)).alias("n"))


@query()
def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mining_tasks", "task_id", "path", "nb_json").dropDuplicates(["task_id"]).filter(F.lower("path").endswith(".ipynb"))
    return code.notebook_cells(t, "task_id", "nb_json").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("source")).alias("mean_chars"))


@query()
def resilient_parse(spark: SparkSession, d: str) -> DataFrame:
    """The status of parsing each code under a time limit."""
    import ast

    r = resilient_map(_codes(spark, d), "rec_id", "code", lambda c: len(ast.parse(c).body), 5.0)
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id % 5 AS obj_id, w AS src_seq, event_id AS dst_seq FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM events) WHERE event_type = 'view' AND w IS NOT NULL")
def stream_dependencies(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "view", "read")
    e = s.select((F.col("user_id") % 5).alias("obj_id"), F.col("event_id").alias("seq"), kind.alias("kind")).filter("kind is not null")
    name = f"deps_{uuid.uuid4().hex[:10]}"
    return streams.run_once(streams.dependencies(e), f"{scratch_dir(spark)}/{name}-out", f"{scratch_dir(spark)}/{name}")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    name = f"hours_{uuid.uuid4().hex[:10]}"
    out = streams.run_once(streams.tumbling(s, "ts", "1 hour", "1 hour", ["event_type"], "value"), f"{scratch_dir(spark)}/{name}-out", f"{scratch_dir(spark)}/{name}", "complete")
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("total", 3).alias("total"))
