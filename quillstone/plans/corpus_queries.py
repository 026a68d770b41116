"""Queries of the corpus dataflow, of retrieval and of comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.operators import compare, corpus, search
from quillstone.sources.store import latest
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


@query("SELECT DISTINCT n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def star_join_distinct(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_mktsegment").distinct()
    return g.join(F.broadcast(table(spark, d, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct()


@query("SELECT text, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, min(doc_id) AS first_seq FROM documents GROUP BY text")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return corpus.keep_last(table(spark, d, "documents", "text", "doc_id", "source"), "text", "doc_id").select("text", "doc_id", "source", "first_seq")


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'tutorials' UNION ALL SELECT min(doc_id), 'tutorials' FROM documents WHERE source = 'tutorials' HAVING count(*) > 0")
def representative_collapse(spark: SparkSession, d: str) -> DataFrame:
    return corpus.collapse(table(spark, d, "documents", "doc_id", "source"), F.col("source") == "tutorials", "doc_id")


_ITEMS = "(SELECT item_id, any_value(code) AS code, any_value(template) AS template, any_value(support) AS support, any_value(kind) AS kind FROM preprocessed_items GROUP BY item_id)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preprocessed_items", "item_id", "code", "template", "support", "kind").dropDuplicates(["item_id"])


@query(f"SELECT code, count(*) AS support, max(item_id) AS item_id, arg_max(kind, item_id) AS kind FROM {_ITEMS} GROUP BY code")
def support_count(spark: SparkSession, d: str) -> DataFrame:
    return corpus.support(_items(spark, d).select("item_id", "code", "kind"), "code", "item_id").select("code", "support", "item_id", "kind")


@query(f"""SELECT template, CAST(support AS BIGINT) AS support, row_number() OVER (ORDER BY support DESC, first_seq, template) - 1 AS place FROM (SELECT template, coalesce(sum(support), 0) AS support, min(item_id) AS first_seq FROM {_ITEMS} WHERE template IS NOT NULL GROUP BY template)""")
def group_support_rank(spark: SparkSession, d: str) -> DataFrame:
    return corpus.group_support(_items(spark, d), "template", "support", "item_id").select("template", "support", F.col("place").cast("long").alias("place"))


@query(f"SELECT kind, template, n FROM (SELECT kind, template, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, template) r FROM {_ITEMS} WHERE template IS NOT NULL GROUP BY 1, 2) WHERE r <= 5")
def top_templates_per_kind(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = _items(spark, d).filter("template is not null").groupBy("kind", "template").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "template"))).filter("r <= 5").drop("r")


@query("SELECT DISTINCT t.base_uid FROM mining_tasks t WHERE t.base_uid NOT IN (SELECT split_part(uid, ':', 1) FROM autodoc_results WHERE uid IS NOT NULL)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "autodoc_results", "uid").select(F.substring_index("uid", ":", 1).alias("base_uid"))
    return corpus.remaining(table(spark, d, "mining_tasks", "base_uid").distinct(), done, "base_uid")


@query("SELECT DISTINCT t.base_uid FROM mining_tasks t WHERE t.base_uid IN (SELECT split_part(uid, ':', 1) FROM autodoc_results WHERE success)")
def status_semi_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "autodoc_results", "uid", "success").filter("success").select(F.substring_index("uid", ":", 1).alias("base_uid"))
    return corpus.requested(table(spark, d, "mining_tasks", "base_uid").distinct(), done, "base_uid")


@query("SELECT DISTINCT rec_id FROM autodoc_results WHERE success UNION SELECT rec_id FROM autodoc_results WHERE NOT success")
def status_union(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "autodoc_results", "rec_id", "success")
    return corpus.processed(r.filter("success"), r.filter("not success"), "rec_id")


@query(f"SELECT item_id, kind, row_number() OVER (PARTITION BY kind ORDER BY item_id) - 1 AS round FROM {_ITEMS}")
def round_robin_schedule(spark: SparkSession, d: str) -> DataFrame:
    return corpus.round_robin(_items(spark, d).select("item_id", "kind"), "kind", "kind", ["item_id"]).withColumn("round", F.col("round").cast("long"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS chunk FROM orders")
def chunking(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunked(table(spark, d, "orders", "o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey", "chunk")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 20 OFFSET 40")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    return corpus.page(table(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal"), ["s_acctbal", "s_suppkey"], 2, 20).select("s_suppkey", "s_name")


@query("""WITH x AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer) SELECT c_mktsegment, c_custkey, CAST(r AS INT) AS round FROM x, range(20) t(r) WHERE r % n = i""")
def cyclic_sampling(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_mktsegment", "c_nationkey", "c_custkey").withColumn("g", F.struct("c_mktsegment", "c_nationkey"))
    return corpus.cyclic_rounds(c, "g", ["c_custkey"], 20).select("c_mktsegment", "c_custkey", "round")


@query("SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) i FROM supplier) a JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) i FROM supplier) b ON a.s_nationkey = b.s_nationkey AND b.i - a.i BETWEEN 1 AND 3")
def within_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.pairs_within(table(spark, d, "supplier", "s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 3)


_SHUFFLE = "SELECT label, vec_id, md5('0:' || vec_id) AS h, row_number() OVER (ORDER BY label, md5('0:' || vec_id), vec_id) - 1 AS p, row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) - 1 AS r, count(*) OVER () - count(*) OVER (PARTITION BY label) AS o, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL"


@query(f"""WITH x AS ({_SHUFFLE}), f AS (SELECT label, min(p) AS first FROM x GROUP BY 1), t AS (SELECT vec_id, k AS turn, (r + (k - 1) * greatest(1, o // least(3, o))) % o AS a, first, n FROM x JOIN f USING (label), (VALUES (1), (2), (3)) v(k) WHERE k <= o)
SELECT t.vec_id, x.vec_id AS other, CAST(turn AS INT) AS turn FROM t JOIN x ON x.p = CASE WHEN a < first THEN a ELSE a + t.n END""")
def capped_negatives(spark: SparkSession, d: str) -> DataFrame:
    return corpus.negatives(table(spark, d, "embeddings", "vec_id", "label"), "label", "vec_id", 3)


@query("SELECT avg(length(text)) AS mean, min(length(text)) AS least, max(length(text)) AS greatest, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.75) AS p75, quantile_cont(length(text), 0.9) AS p90, quantile_cont(length(text), 0.99) AS p99 FROM documents")
def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.length_report(table(spark, d, "documents", "text"), "text")
    return r.select("mean", F.col("least").cast("long").alias("least"), F.col("greatest").cast("long").alias("greatest"), "p50", "p75", "p90", "p99")


_TRIES = "(SELECT DISTINCT rec_id, coalesce(len(additional_descs), 0) AS tries, success FROM autodoc_results)"


@query(f"SELECT tries, n, CAST(sum(n) OVER (ORDER BY tries) AS BIGINT) AS solved_by_then, sum(n) OVER (ORDER BY tries) / sum(a) OVER () AS rate FROM (SELECT tries, count(*) FILTER (success) AS n, count(*) AS a FROM {_TRIES} GROUP BY tries)")
def cumulative_topk_rate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "autodoc_results", "rec_id", "additional_descs", "success")
    t = t.select("rec_id", F.coalesce(F.size("additional_descs"), F.lit(0)).cast("long").alias("tries"), "success").withColumn("tries", F.greatest("tries", F.lit(0))).distinct()
    return corpus.cumulative_rate(t, "tries", F.col("success"))


@query("SELECT lower(status) AS status, count(*) AS n FROM inspection_items GROUP BY 1")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.outcome_counts(table(spark, d, "inspection_items", "status").select(F.lower("status").alias("status")), "status")


@query("""SELECT is_derived, count(DISTINCT rec_id) AS n_records, count(DISTINCT rec_id) FILTER (success) AS n_success, count(DISTINCT template) AS n_templates, count(DISTINCT rec_id) FILTER (coalesce(len(canonical_descs), 0) = 0) AS n_without FROM autodoc_results GROUP BY 1""")
def campaign_info(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "autodoc_results", "rec_id", "is_derived", "success", "template", "canonical_descs")
    none = F.coalesce(F.size("canonical_descs"), F.lit(0)) <= 0
    return r.groupBy("is_derived").agg(F.countDistinct("rec_id").alias("n_records"), F.countDistinct(F.when(F.col("success"), F.col("rec_id"))).alias("n_success"), F.countDistinct("template").alias("n_templates"), F.countDistinct(F.when(none, F.col("rec_id"))).alias("n_without"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 4) AS in_window FROM events")
def sliding_60s_sum(spark: SparkSession, d: str) -> DataFrame:
    s = corpus.sliding_sum(table(spark, d, "events", "event_id", "ts", "user_id", "value"), "ts", "value", 60, ["user_id"])
    return s.select("event_id", F.round("in_window", 4).alias("in_window"))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events", "user_id", "ts", "event_type", "value"), "user_id", "ts").select("user_id", "event_type", "value")


@query("SELECT doc_id FROM documents WHERE text LIKE '%pandas%' OR (source IN ('tutorials', 'readmes') AND length(text) > 500 AND lang IS NOT NULL)")
def conjunctive_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text", "source", "lang")
    rest = corpus.all_of([F.col("source").isin("tutorials", "readmes"), F.length("text") > 500, F.col("lang").isNotNull()])
    return t.filter(F.coalesce(F.contains("text", F.lit("pandas")), F.lit(False)) | rest).select("doc_id")


@query("SELECT rec_id, desc_no, round(CAST(length(primary_desc) AS DOUBLE), 1) AS n_chars FROM (SELECT DISTINCT rec_id, canonical_descs AS c FROM autodoc_results), LATERAL (SELECT unnest(generate_series(1, len(c))) AS desc_no), LATERAL (SELECT c[desc_no].nl_desc.primary_desc AS primary_desc)")
def explode_descriptions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "autodoc_results", "rec_id", "canonical_descs").select("rec_id", F.col("canonical_descs.nl_desc.primary_desc").alias("p")).dropDuplicates(["rec_id"])
    x = r.select("rec_id", F.posexplode("p").alias("i", "t"))
    return x.select("rec_id", (F.col("i") + 1).cast("long").alias("desc_no"), F.length("t").cast("double").alias("n_chars"))


_COSINE = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS own, v.label, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return search.top_k(v.filter(F.col("vec_id") % 50 == 0), v, "vec_id", "embedding", k)


@query(_COSINE + "SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_COSINE + """, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 100), u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1)
SELECT query_id, label, vec_id, rank FROM (SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM u) WHERE rank <= 5""")
def cosine_topk_dedup(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d, 100).join(table(spark, d, "embeddings", "vec_id", "label"), "vec_id")
    return search.distinct_hits(h, "label", 100, 5).select("query_id", "label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(_COSINE + """, h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 100) SELECT query_id, label, vec_id FROM h WHERE own <> label QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) = 1""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return search.hard_negatives(_hits(spark, d, 100), table(spark, d, "embeddings", "vec_id", "label"), "vec_id", "label").select("query_id", "label", "vec_id")


@query()
def cosine_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return search.approximate_top_k(v.filter(F.col("vec_id") % 50 == 0), v, "vec_id", "embedding", 10)


_BM25 = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)')) AS term FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS n_terms FROM t GROUP BY 1), i AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(intent), '([a-z0-9_]+)')) AS term FROM inspection_items WHERE item_id % 50 = 0) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM i GROUP BY 1), s AS (SELECT count(*) AS nd, avg(coalesce(n_terms, 0)) AS m FROM documents LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL)
SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * qf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / m))), 6) AS score FROM i JOIN q USING (term) JOIN f USING (term) JOIN n USING (doc_id), s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""


@query(_BM25)
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").isNotNull())
    index = search.inverted_index(docs, "doc_id", "text")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(search.terms(F.col("text")))).alias("m")).first()
    q = table(spark, d, "inspection_items", "item_id", "intent").filter(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), F.explode(search.terms(F.col("intent"))).alias("term"))
    return search.bm25(index, stats.n, stats.m, q, "doc_id").select("query_id", "doc_id", "score")


@query("SELECT o.o_orderkey, 'o_totalprice' AS column_name, CAST(round(o_totalprice, 2) AS VARCHAR) AS left_value, CAST(round(CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS VARCHAR) AS right_value FROM orders o WHERE o_orderkey % 500 = 0")
def compare_cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    text = lambda c: F.format_string("%.2f", c)
    a = o.select("o_orderkey", text(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    b = o.select("o_orderkey", text(F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).alias("o_totalprice"), "o_orderstatus")
    x = compare.differences(a, b, ["o_orderkey"])
    shown = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d)0$", "$1"), r"^$", "")
    return x.select("o_orderkey", "column_name", shown("left_value").alias("left_value"), shown("right_value").alias("right_value"))


@query("SELECT true AS same_rows, false AS same_changed")
def tolerant_compare(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    other = n.select(F.col("n_name").alias("b"), F.col("n_regionkey").cast("double").alias("c"), F.col("n_nationkey").cast("long").alias("a")).orderBy("b")
    changed = n.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 3, 9).otherwise(F.col("n_regionkey")))
    return spark.createDataFrame([(compare.same(n, other), compare.same(n, changed))], "same_rows boolean, same_changed boolean")
