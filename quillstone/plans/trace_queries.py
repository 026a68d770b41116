"""Trace queries over the event table: users are runs, purchases write, views read, signups define, clicks access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstone.operators import joins, trace
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


#: Bin width of the range joins: about the length of an item.
WIDTH = 40


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "write", "view", "read", "signup", "def", "click", "access", "error", "error")])[F.col("event_type")]
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("event_type") == "click", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w))
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), kind.alias("kind"), (F.col("event_id") % 7).alias("owner_item_id"), (F.col("user_id") % 5).alias("obj_id"),
        F.concat(F.lit("v"), F.col("event_id") % 3).alias("name"), F.lit(0).cast("long").alias("scope_id"), known.alias("def_event_seq"),
    )


_EVENTS = """WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_id AS ts, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'def' WHEN 'click' THEN 'access' ELSE 'error' END AS kind, user_id % 5 AS obj_id, 'v' || (event_id % 3) AS name,
CASE WHEN event_type = 'click' THEN last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS def_event_seq FROM events)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """An item per purchase or error, lasting for a number of ticks that depends on it."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type").filter("event_type in ('purchase', 'error')")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.col("event_id").alias("start_time"), (F.col("event_id") + 5 + F.col("event_id") % 60).alias("end_time"), F.lit(0).cast("long").alias("scope_id"),
        F.when(F.col("event_type") == "purchase", "statement").otherwise("expression").alias("item_type"), (F.col("user_id") % 5).alias("obj_id"), F.lit(None).cast("long").alias("parent_item_id"),
    )


_ITEMS = ", i AS (SELECT user_id AS run_id, event_id AS item_id, event_id AS start_time, event_id + 5 + event_id % 60 AS end_time, CASE event_type WHEN 'purchase' THEN 'statement' ELSE 'expression' END AS item_type FROM events WHERE event_type IN ('purchase', 'error'))"
_DEPS = """, d AS (SELECT run_id, w AS src_seq, w AS src_ts, seq AS dst_seq, ts AS dst_ts, obj_id, 'RAW' AS dep_type FROM (SELECT *, last_value(CASE WHEN kind = 'write' THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id, obj_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM e) WHERE kind = 'read' AND w IS NOT NULL
UNION ALL SELECT run_id, def_event_seq, def_event_seq, seq, ts, obj_id, 'DEF_ACCESS' FROM e WHERE kind = 'access' AND def_event_seq IS NOT NULL)"""


@query(_EVENTS + _DEPS + " SELECT run_id, src_seq, dst_seq, obj_id, dep_type FROM d")
def raw_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return trace.dependencies(_events(spark, d)).select("run_id", "src_seq", "dst_seq", "obj_id", "dep_type")


@query(_EVENTS + _ITEMS + " SELECT e.run_id, e.seq, i.item_id FROM e JOIN i ON e.run_id = i.run_id AND e.ts >= i.start_time AND e.ts < i.end_time WHERE e.kind = 'read'")
def stabbing_join(spark: SparkSession, d: str) -> DataFrame:
    p = _events(spark, d).filter("kind = 'read'").select("run_id", "seq", F.col("ts").alias("t"))
    return trace.enveloping_items(p, _items(spark, d), WIDTH).select("run_id", "seq", "item_id")


@query(_EVENTS + _ITEMS + _DEPS + """ SELECT d.run_id, i.item_id, src_seq, dst_seq, CASE WHEN src_ts < start_time THEN 'external' ELSE 'internal' END AS side FROM d JOIN i ON d.run_id = i.run_id AND dst_ts >= start_time AND dst_ts < end_time WHERE src_ts < end_time""")
def external_internal_deps(spark: SparkSession, d: str) -> DataFrame:
    return trace.item_dependencies(_items(spark, d), trace.dependencies(_events(spark, d)), WIDTH)


@query(_EVENTS + _ITEMS + " SELECT e.run_id, item_id, name, max(seq) AS def_seq FROM e JOIN i ON e.run_id = i.run_id AND ts >= start_time AND ts < end_time WHERE kind = 'def' GROUP BY 1, 2, 3")
def exposed_definitions(spark: SparkSession, d: str) -> DataFrame:
    return trace.exposed_definitions(_items(spark, d), _events(spark, d), WIDTH).select("run_id", "item_id", "name", "def_seq")


@query(_EVENTS + _ITEMS + _DEPS + """, x AS (SELECT e.run_id, item_id, name, max(seq) AS def_seq FROM e JOIN i ON e.run_id = i.run_id AND ts >= start_time AND ts < end_time WHERE kind = 'def' GROUP BY 1, 2, 3)
SELECT d.run_id, src_seq, dst_seq, i.item_id, 'explicit' AS how FROM d JOIN i ON d.run_id = i.run_id AND src_ts >= start_time AND src_ts < end_time AND end_time <= dst_ts WHERE dep_type = 'RAW'
UNION ALL SELECT d.run_id, src_seq, dst_seq, x.item_id, 'explicit' FROM d JOIN x ON d.run_id = x.run_id AND d.src_seq = x.def_seq JOIN i ON i.item_id = x.item_id AND i.run_id = d.run_id WHERE dep_type = 'DEF_ACCESS' AND end_time <= dst_ts
UNION ALL SELECT d.run_id, src_seq, dst_seq, i.item_id, 'implicit' FROM d JOIN i ON d.run_id = i.run_id AND src_ts >= start_time AND src_ts < end_time AND dst_ts >= start_time AND dst_ts < end_time""")
def resolving_items(spark: SparkSession, d: str) -> DataFrame:
    e, i = _events(spark, d), _items(spark, d)
    return trace.resolving_items(trace.dependencies(e), i, e, WIDTH)


@query(_EVENTS + " SELECT run_id, def_event_seq, count(*) AS n_accesses FROM e WHERE kind = 'access' AND def_event_seq IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def multi_use_definitions(spark: SparkSession, d: str) -> DataFrame:
    return trace.used_more_than_once(_events(spark, d))


@query(_EVENTS + " SELECT run_id, obj_id, min(ts) AS first_ts FROM e WHERE kind = 'access' GROUP BY 1, 2")
def first_access(spark: SparkSession, d: str) -> DataFrame:
    return trace.first_access(_events(spark, d))


@query(_EVENTS + ", r AS (SELECT *, sum(CASE WHEN kind = 'def' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, name ORDER BY seq) AS range_no FROM e WHERE kind IN ('def', 'access')) SELECT run_id, name, CAST(range_no AS BIGINT) AS range_no, min(seq) AS start_seq, max(seq) AS end_seq FROM r WHERE range_no > 0 GROUP BY 1, 2, 3")
def live_ranges(spark: SparkSession, d: str) -> DataFrame:
    return trace.live_ranges(_events(spark, d)).select("run_id", "name", "range_no", "start_seq", "end_seq")


@query()
def interval_colouring(spark: SparkSession, d: str) -> DataFrame:
    return trace.colour(trace.live_ranges(_events(spark, d)).select("run_id", "name", "start_seq", "end_seq"), ["run_id"], "start_seq", "end_seq", "name")


@query("SELECT v.event_id, b.value FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON v.user_id = b.user_id AND v.event_id > b.event_id")
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    v, b = e.filter("event_type = 'view'").select("event_id", "user_id"), e.filter("event_type = 'purchase'").select("event_id", "user_id", "value")
    return trace.latest_before(v, b, "event_id", ["user_id"], ["value"]).select("event_id", "value")


@query("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events WHERE event_type = 'purchase'")
def version_validity(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events", "event_id", "user_id", "event_type").filter("event_type = 'purchase'").drop("event_type")
    return trace.validity(b, ["user_id"], "event_id")


@query("WITH RECURSIVE a AS (SELECT s_suppkey AS item_id, s_suppkey // 2 AS ancestor_id, 1 AS depth FROM supplier WHERE s_suppkey // 2 >= 1 UNION ALL SELECT item_id, ancestor_id // 2, depth + 1 FROM a WHERE ancestor_id // 2 >= 1) SELECT item_id, ancestor_id, CAST(depth AS BIGINT) AS depth FROM a")
def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_suppkey")
    up = F.floor(F.col("s_suppkey") / 2).cast("long")
    return trace.ancestors(s.select(F.lit(1).alias("run_id"), F.col("s_suppkey").alias("item_id"), F.when(up >= 1, up).alias("parent_item_id"))).select("item_id", "ancestor_id", "depth")


@query("""WITH RECURSIVE g AS (SELECT s_suppkey AS node, s_suppkey // 2 AS next FROM supplier UNION SELECT s_suppkey, s_suppkey // 3 + 1 FROM supplier), r AS (SELECT s_suppkey AS root, s_suppkey AS node FROM supplier UNION SELECT root, next FROM r JOIN g USING (node) WHERE next <> 4) SELECT root, node FROM r""")
def backward_slice(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_suppkey")
    to = lambda e: s.select(F.lit(1).alias("run_id"), F.col("s_suppkey").alias("node"), e.cast("long").alias("next"))
    edges = to(F.floor(F.col("s_suppkey") / 2)).union(to(F.floor(F.col("s_suppkey") / 3) + 1)).distinct()
    seeds = s.select(F.lit(1).alias("run_id"), F.col("s_suppkey").alias("node"))
    barred = spark.createDataFrame([(1, 4)], "run_id int, node long")
    return trace.reachable(edges, seeds, barred).select("root", "node")


@query("""WITH a AS (SELECT event_id AS k, user_id, event_id AS s, event_id + 3 + event_id % 50 AS e FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS j, user_id, event_id AS s, event_id + 1 + event_id % 90 AS e FROM events WHERE event_type = 'error')
SELECT k, j FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    k = F.col("event_id")
    a = e.filter("event_type = 'purchase'").select(k.alias("k"), "user_id", k.alias("s1"), (k + 3 + k % 50).alias("e1"))
    b = e.filter("event_type = 'error'").select(k.alias("j"), "user_id", k.alias("s2"), (k + 1 + k % 90).alias("e2"))
    return joins.overlaps(a, b, "s1", "e1", "s2", "e2", WIDTH, ["user_id"]).select("k", "j")


@query(_EVENTS + " SELECT run_id, seq, kind FROM e WHERE ts >= 1000 AND ts < 5000")
def events_in_range(spark: SparkSession, d: str) -> DataFrame:
    return trace.events_between(_events(spark, d), 1000, 5000).select("run_id", "seq", "kind")


@query(_EVENTS + _ITEMS + " SELECT run_id, item_id, start_time, end_time FROM i WHERE start_time >= 1000 AND end_time <= 5000")
def items_in_range(spark: SparkSession, d: str) -> DataFrame:
    return trace.items_within(_items(spark, d), 1000, 5000).select("run_id", "item_id", "start_time", "end_time")


@query(_EVENTS + _ITEMS + " SELECT run_id, coalesce(events_end, 0) AS events_end, items_end FROM (SELECT run_id, max(ts) + 1 AS events_end FROM e GROUP BY 1) FULL JOIN (SELECT run_id, max(end_time) AS items_end FROM i GROUP BY 1) USING (run_id)")
def run_ends(spark: SparkSession, d: str) -> DataFrame:
    return trace.last_times(_events(spark, d), _items(spark, d))


_TREE = "WITH RECURSIVE t AS (SELECT s_suppkey AS item_id, CASE WHEN s_suppkey // 2 >= 1 THEN s_suppkey // 2 END AS parent_item_id, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey = 1 THEN 'statement' ELSE 'expression' END AS item_type FROM supplier)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    up = F.floor(k / 2).cast("long")
    kind = F.when((k % 3 == 0) | (k == 1), "statement").otherwise("expression")
    return table(spark, d, "supplier", "s_suppkey").select(F.lit(1).alias("run_id"), k.alias("item_id"), F.when(up >= 1, up).alias("parent_item_id"), kind.alias("item_type"))


@query(_TREE + ", a AS (SELECT parent_item_id AS item_id, item_id AS descendant_id, 1 AS depth FROM t WHERE parent_item_id IS NOT NULL UNION ALL SELECT p.parent_item_id, descendant_id, depth + 1 FROM a JOIN t p ON p.item_id = a.item_id WHERE p.parent_item_id IS NOT NULL) SELECT item_id, descendant_id, CAST(depth AS BIGINT) AS depth, (SELECT count(*) FROM t c WHERE c.parent_item_id = a.item_id) AS n_children FROM a")
def children_and_descendants(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    n = trace.children(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_children"))
    return trace.descendants(t).join(n, "item_id").select("item_id", "descendant_id", "depth", "n_children")


@query(_TREE + ", a AS (SELECT item_id, item_id AS here, item_type, 0 AS depth FROM t UNION ALL SELECT a.item_id, p.item_id, p.item_type, depth + 1 FROM a JOIN t c ON c.item_id = a.here JOIN t p ON p.item_id = c.parent_item_id) SELECT item_id, arg_min(here, depth) AS statement_id FROM a WHERE item_type = 'statement' GROUP BY 1")
def statement_owners(spark: SparkSession, d: str) -> DataFrame:
    return trace.owning_statements(_tree(spark, d)).select("item_id", "statement_id")


@query(_EVENTS + _ITEMS + " SELECT e.run_id, e.seq, i.item_id FROM e JOIN i ON e.run_id = i.run_id AND ts >= start_time AND ts < end_time WHERE kind <> 'def' UNION ALL SELECT run_id, max(seq), item_id FROM (SELECT e.run_id, item_id, name, seq FROM e JOIN i ON e.run_id = i.run_id AND ts >= start_time AND ts < end_time WHERE kind = 'def') GROUP BY run_id, item_id, name")
def affording_items(spark: SparkSession, d: str) -> DataFrame:
    return trace.affording_items(_events(spark, d), _items(spark, d), WIDTH).select("run_id", "seq", "item_id")


@query(_EVENTS + " SELECT run_id, obj_id, seq FROM e WHERE kind = 'def' AND ts >= 2000 AND ts < 8000")
def definitions_of_objects(spark: SparkSession, d: str) -> DataFrame:
    return trace.object_definitions(_events(spark, d), 2000, 8000).select("run_id", "obj_id", "seq")


@query(_EVENTS + _ITEMS + " SELECT run_id, run_id % 5 AS obj_id, item_id FROM (SELECT *, max(end_time) OVER (PARTITION BY run_id) AS m FROM i) WHERE end_time < m")
def items_of_objects(spark: SparkSession, d: str) -> DataFrame:
    """Expression items by object (the object index), those that end with the run left out."""
    return trace.object_items(_items(spark, d), True).select("run_id", "obj_id", "item_id")


@query(_EVENTS + _ITEMS + " SELECT run_id, item_id, (SELECT max(end_time) FROM i o WHERE o.run_id = i.run_id AND o.end_time <= i.start_time) AS latest FROM i")
def latest_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    return trace.latest_cutoff(i.select("run_id", "item_id", "start_time"), i.select("run_id", "end_time"), ["run_id"]).select("run_id", "item_id", "latest")


@query("""WITH RECURSIVE g AS (SELECT s_suppkey AS node, s_suppkey // 2 AS next FROM supplier UNION SELECT s_suppkey, s_suppkey // 3 + 1 FROM supplier), r AS (SELECT s_suppkey AS root, s_suppkey AS node FROM supplier UNION SELECT root, next FROM r JOIN g USING (node)),
b AS (SELECT DISTINCT node FROM r WHERE node >= 1 AND node % 4 = 2 AND node + 3 <= 60), f AS (SELECT s_suppkey AS root, s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (FROM b) UNION SELECT root, next FROM f JOIN g USING (node) WHERE next NOT IN (FROM b)) SELECT root, node FROM f""")
def slice_in_two_passes(spark: SparkSession, d: str) -> DataFrame:
    """Items of object 2 that end by 60 are barred in the second pass."""
    s = table(spark, d, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    to = lambda e: s.select(F.lit(1).alias("run_id"), k.alias("node"), e.cast("long").alias("next"))
    edges = to(F.floor(k / 2)).union(to(F.floor(k / 3) + 1)).distinct()
    items = s.select(F.lit(1).alias("run_id"), k.alias("item_id"), (k % 4).alias("obj_id"), (k + 3).alias("end_time"))
    cutoff = spark.createDataFrame([(1, 2, 60)], "run_id int, obj_id long, latest long")
    return trace.slice_without(edges, s.select(F.lit(1).alias("run_id"), k.alias("node")), items, cutoff).select("root", "node")


_RANGES = ", r AS (SELECT run_id, name, CAST(range_no AS BIGINT) AS range_no, min(seq) AS start_seq, max(seq) AS end_seq FROM (SELECT *, sum(CASE WHEN kind = 'def' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, name ORDER BY seq) AS range_no FROM e WHERE kind IN ('def', 'access')) WHERE range_no > 0 GROUP BY 1, 2, 3)"


@query("WITH RECURSIVE " + _EVENTS[5:] + _RANGES + """, c AS (SELECT run_id, seq AS def_seq, p AS access_seq FROM (SELECT run_id, seq, kind, lag(seq) OVER w AS p, lag(kind) OVER w AS pk FROM e WHERE kind IN ('def', 'access') WINDOW w AS (PARTITION BY run_id ORDER BY seq)) WHERE kind = 'def' AND pk = 'access'),
l AS (SELECT r.run_id, r.start_seq, min(b.start_seq) AS before FROM r LEFT JOIN c ON c.run_id = r.run_id AND c.def_seq = r.start_seq LEFT JOIN r b ON b.run_id = r.run_id AND b.end_seq = c.access_seq AND b.start_seq < r.start_seq GROUP BY 1, 2),
m AS (SELECT run_id, start_seq, start_seq AS root FROM l WHERE before IS NULL UNION ALL SELECT l.run_id, l.start_seq, m.root FROM m JOIN l ON l.run_id = m.run_id AND l.before = m.start_seq) SELECT r.run_id, r.name, r.range_no, m.root AS root_seq FROM r JOIN m USING (run_id, start_seq)""")
def merged_live_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A definition right behind an access is taken for the assignment of what was read."""
    e = _events(spark, d)
    w = Window.partitionBy("run_id").orderBy("seq")
    x = e.filter("kind in ('def', 'access')").select("run_id", "scope_id", "kind", F.col("seq").alias("def_seq"), F.lag("seq").over(w).alias("access_seq"), F.lag("kind").over(w).alias("before"))
    copies = x.filter("kind = 'def' and before = 'access'")
    return trace.merge_ranges(trace.live_ranges(e), copies).select("run_id", "name", "range_no", "root_seq")


@query(_EVENTS + ", x AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, seq) - 1 AS clock FROM e) SELECT run_id, seq, clock FROM x")
def logical_clock(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.operators.frame import position

    return position(_events(spark, d), ["ts", "seq"], "clock", ["run_id"]).select("run_id", "seq", F.col("clock").cast("long").alias("clock"))
