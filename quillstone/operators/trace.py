"""Queries over execution traces: items are half-open intervals in a tree, events are points of a logical clock.

Tables: items(run_id, item_id, start_time, end_time, scope_id, item_type, obj_id, parent_item_id) and events(run_id,
seq, ts, kind, owner_item_id, obj_id, name, scope_id, def_event_seq). Events apply in the order of seq within a run.
Every operator takes and returns DataFrames; runs are independent, so that run_id is part of every partitioning.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window, functions as F

from quillstone.operators.joins import stab
from quillstone.session import materialize


def events_between(events: DataFrame, start=None, end=None) -> DataFrame:
    """Events with start <= ts < end; a missing bound is open."""
    out = events if start is None else events.filter(F.col("ts") >= start)
    return out if end is None else out.filter(F.col("ts") < end)


def items_within(items: DataFrame, start=None, end=None) -> DataFrame:
    """Items that lie inside [start, end]; a missing end is the last end of the run."""
    out = items if start is None else items.filter(F.col("start_time") >= start)
    return out if end is None else out.filter(F.col("end_time") <= end)


def last_times(events: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, events_end, items_end): one past the last event (0 without events) and the last end of an item."""
    e = events.groupBy("run_id").agg((F.max("ts") + 1).alias("events_end"))
    i = items.groupBy("run_id").agg(F.max("end_time").alias("items_end"))
    return e.join(i, "run_id", "full_outer").select("run_id", F.coalesce("events_end", F.lit(0)).alias("events_end"), "items_end")


def enveloping_items(points: DataFrame, items: DataFrame, width: int, at: str = "t", until: str | None = None) -> DataFrame:
    """(columns of points, item_id): items that hold the time `at`, and with `until` also that time."""
    i = items.select("run_id", "item_id", "start_time", "end_time")
    got = stab(points, i, at, "start_time", "end_time", width, ["run_id"])
    if until:
        got = got.filter((F.col(until) >= F.col("start_time")) & (F.col(until) < F.col("end_time")))
    return got.drop("start_time", "end_time")


def children(items: DataFrame) -> DataFrame:
    """(run_id, item_id, child_id)."""
    return items.filter(F.col("parent_item_id").isNotNull()).select("run_id", F.col("parent_item_id").alias("item_id"), F.col("item_id").alias("child_id"))


def ancestors(items: DataFrame) -> DataFrame:
    """(run_id, item_id, ancestor_id, depth): the chain of parents of every item, by pointer doubling.

    Rounds grow with the logarithm of the depth. A cycle among parents raises.
    """
    p = items.filter(F.col("parent_item_id").isNotNull()).select("run_id", "item_id", F.col("parent_item_id").alias("ancestor_id"), F.lit(1).cast("long").alias("depth"))
    known = materialize(p, "anc")
    size = known.count()
    while True:
        reach = known.groupBy("run_id", "item_id").agg(F.max(F.struct("depth", "ancestor_id")).alias("m")).select("run_id", F.col("item_id"), F.col("m.ancestor_id").alias("via"), F.col("m.depth").alias("d0"))
        more = reach.join(known.select("run_id", F.col("item_id").alias("via"), "ancestor_id", "depth"), ["run_id", "via"]).select("run_id", "item_id", "ancestor_id", (F.col("d0") + F.col("depth")).alias("depth"))
        known = materialize(known.unionByName(more), "anc")
        if not known.filter(F.col("item_id") == F.col("ancestor_id")).isEmpty():
            raise ValueError("parents form a cycle")
        now = known.count()
        if now == size:
            return known
        size = now


def descendants(items: DataFrame) -> DataFrame:
    """(run_id, item_id, descendant_id, depth)."""
    return ancestors(items).select("run_id", F.col("ancestor_id").alias("item_id"), F.col("item_id").alias("descendant_id"), "depth")


def dependencies(events: DataFrame) -> DataFrame:
    """(run_id, src_seq, src_ts, dst_seq, dst_ts, obj_id, dep_type) in order of seq.

    RAW: a read depends on the last write of its object before it. DEF_ACCESS: an access depends on the definition it
    names. A read without an earlier write, and an access without a known definition, depend on nothing.
    """
    w = Window.partitionBy("run_id", "obj_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("kind") == "write", F.struct("seq", "ts"))
    raw = (
        events.filter(F.col("kind").isin("read", "write") & F.col("obj_id").isNotNull())
        .withColumn("src", F.last(write, ignorenulls=True).over(w))
        .filter((F.col("kind") == "read") & F.col("src").isNotNull())
        .select("run_id", F.col("src.seq").alias("src_seq"), F.col("src.ts").alias("src_ts"), F.col("seq").alias("dst_seq"), F.col("ts").alias("dst_ts"), "obj_id", F.lit("RAW").alias("dep_type"))
    )
    d = events.filter(F.col("kind") == "def").select("run_id", F.col("seq").alias("src_seq"), F.col("ts").alias("src_ts"))
    a = events.filter((F.col("kind") == "access") & F.col("def_event_seq").isNotNull())
    acc = a.withColumn("src_seq", F.col("def_event_seq")).join(d, ["run_id", "src_seq"]).select("run_id", "src_seq", "src_ts", F.col("seq").alias("dst_seq"), F.col("ts").alias("dst_ts"), "obj_id", F.lit("DEF_ACCESS").alias("dep_type"))
    return raw.unionByName(acc)


def item_dependencies(items: DataFrame, deps: DataFrame, width: int) -> DataFrame:
    """(run_id, item_id, src_seq, dst_seq, side): dependencies that reach into an item.

    internal: both ends inside. external: the item holds the later end, the earlier lies before it.
    """
    i = items.select("run_id", "item_id", "start_time", "end_time")
    j = stab(deps, i, "dst_ts", "start_time", "end_time", width, ["run_id"])
    side = F.when(F.col("src_ts") < F.col("start_time"), "external").when(F.col("src_ts") < F.col("end_time"), "internal")
    return j.withColumn("side", side).filter(F.col("side").isNotNull()).select("run_id", "item_id", "src_seq", "dst_seq", "side")


def exposed_definitions(items: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """(run_id, item_id, name, scope_id, def_seq): per item and name, the last definition made while the item runs.

    Only definitions with an owner, and items in the definition's own scope, count.
    """
    d = events.filter((F.col("kind") == "def") & F.col("owner_item_id").isNotNull()).select("run_id", "seq", "ts", "name", "scope_id")
    i = items.select("run_id", "item_id", "start_time", "end_time", F.col("scope_id").alias("item_scope"))
    j = stab(d, i, "ts", "start_time", "end_time", width, ["run_id"]).filter(F.col("scope_id") == F.col("item_scope"))
    return j.groupBy("run_id", "item_id", "name", "scope_id").agg(F.max("seq").alias("def_seq"))


def affording_items(events: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(run_id, seq, item_id): for a definition the items that expose it, for other events those that hold them."""
    other = enveloping_items(events.filter(F.col("kind") != "def").select("run_id", "seq", F.col("ts").alias("t")), items, width).select("run_id", "seq", "item_id")
    return other.unionByName(exposed_definitions(items, events, width).select("run_id", F.col("def_seq").alias("seq"), "item_id"))


def resolving_items(deps: DataFrame, items: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """(run_id, src_seq, dst_seq, item_id, how): items that settle a dependency.

    explicit: items that end by the later event and hold the write, or expose the definition. implicit: items that hold
    both events.
    """
    i = items.select("run_id", "item_id", "end_time")
    raw = deps.filter("dep_type = 'RAW'").withColumn("t", F.col("src_ts"))
    held = enveloping_items(raw, items, width).join(i, ["run_id", "item_id"]).filter(F.col("end_time") <= F.col("dst_ts"))
    shown = exposed_definitions(items, events, width).select("run_id", "item_id", F.col("def_seq").alias("src_seq"))
    defs = deps.filter("dep_type = 'DEF_ACCESS'").join(shown, ["run_id", "src_seq"]).join(i, ["run_id", "item_id"]).filter(F.col("end_time") <= F.col("dst_ts"))
    both = enveloping_items(deps.withColumn("t", F.col("src_ts")), items, width, "t", "dst_ts")
    pick = lambda df, how: df.select("run_id", "src_seq", "dst_seq", "item_id", F.lit(how).alias("how"))
    return pick(held, "explicit").unionByName(pick(defs, "explicit")).unionByName(pick(both, "implicit"))


def object_definitions(events: DataFrame, start=None, end=None) -> DataFrame:
    """(run_id, obj_id, seq, ts) of definitions of objects in a time range."""
    return events_between(events.filter((F.col("kind") == "def") & F.col("obj_id").isNotNull()), start, end).select("run_id", "obj_id", "seq", "ts")


def object_items(items: DataFrame, last_exclusive: bool = False) -> DataFrame:
    """(run_id, obj_id, item_id, start_time, end_time) of items that evaluate to an object.

    last_exclusive leaves out items that end with the run, as a bound exclusive of the last end does.
    """
    out = items.filter(F.col("obj_id").isNotNull()).select("run_id", "obj_id", "item_id", "start_time", "end_time")
    if last_exclusive:
        out = out.withColumn("m", F.max("end_time").over(Window.partitionBy("run_id"))).filter(F.col("end_time") < F.col("m")).drop("m")
    return out


def owning_statements(items: DataFrame, statement: str = "statement") -> DataFrame:
    """(run_id, item_id, statement_id): the item itself if it is a statement, else its nearest ancestor that is."""
    s = items.filter(F.col("item_type") == statement).select("run_id", F.col("item_id").alias("ancestor_id"))
    own = s.select("run_id", F.col("ancestor_id").alias("item_id"), F.col("ancestor_id").alias("statement_id"))
    up = ancestors(items).join(s, ["run_id", "ancestor_id"]).groupBy("run_id", "item_id").agg(F.min_by("ancestor_id", "depth").alias("statement_id"))
    return own.unionByName(up.join(own.select("run_id", "item_id"), ["run_id", "item_id"], "left_anti"))


def reachable(edges: DataFrame, seeds: DataFrame, barred: DataFrame | None = None) -> DataFrame:
    """(run_id, root, node, depth): nodes reached from each seed along edges(run_id, node, next), each at its least depth.

    Breadth first; each round joins only the newest nodes with the edges and is written to the shared folder. Nodes in
    `barred` (run_id, node) are neither reached nor passed. Cycles end as no new node turns up.
    """
    front = seeds.select("run_id", F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    if barred is not None:
        edges = edges.join(barred.select("run_id", F.col("node").alias("next")), ["run_id", "next"], "left_anti")
    front = materialize(front, "bfs")
    seen = front
    for depth in itertools.count(1):  # each round reaches a new node, so they end
        step = front.select("run_id", "root", "node").join(edges, ["run_id", "node"]).select("run_id", "root", F.col("next").alias("node")).distinct()
        front = materialize(step.join(seen.select("run_id", "root", "node"), ["run_id", "root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 50 == 0:
            seen = materialize(seen, "bfs")


def slice_edges(items: DataFrame, deps: DataFrame, resolvers: DataFrame, width: int, statement: str = "statement") -> DataFrame:
    """(run_id, node, next): from a statement to the one that settles each of its external dependencies.

    Of several resolvers that are statements, the one with the least (end_time, start_time, item_id).
    """
    ext = item_dependencies(items.filter(F.col("item_type") == statement), deps, width).filter("side = 'external'")
    st = items.filter(F.col("item_type") == statement).select("run_id", "item_id", F.struct("end_time", "start_time", "item_id").alias("o"))
    first = resolvers.join(st, ["run_id", "item_id"]).groupBy("run_id", "src_seq", "dst_seq").agg(F.min("o").alias("o")).select("run_id", "src_seq", "dst_seq", F.col("o.item_id").alias("next"))
    return ext.join(first, ["run_id", "src_seq", "dst_seq"]).select("run_id", F.col("item_id").alias("node"), "next").filter(F.col("node") != F.col("next")).distinct()


def latest_before(points: DataFrame, versions: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Each point with the newest version strictly before it."""
    from quillstone.operators.joins import asof

    return asof(points, versions, on, by, values, "backward", exact=False)


def validity(versions: DataFrame, by: list[str], at: str) -> DataFrame:
    """Versions with `valid_to`, the time of the next one of the same object (null for the last)."""
    return versions.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*by).orderBy(at)))


def used_more_than_once(events: DataFrame) -> DataFrame:
    """(run_id, def_event_seq, n_accesses) of definitions with several accesses."""
    a = events.filter((F.col("kind") == "access") & F.col("def_event_seq").isNotNull())
    return a.groupBy("run_id", "def_event_seq").agg(F.count(F.lit(1)).alias("n_accesses")).filter("n_accesses > 1")


def first_access(events: DataFrame) -> DataFrame:
    """(run_id, obj_id, first_ts)."""
    return events.filter((F.col("kind") == "access") & F.col("obj_id").isNotNull()).groupBy("run_id", "obj_id").agg(F.min("ts").alias("first_ts"))


def live_ranges(events: DataFrame) -> DataFrame:
    """(run_id, name, scope_id, range_no, start_seq, end_seq): a definition opens a range, accesses extend it.

    Accesses before any definition belong to no range.
    """
    w = Window.partitionBy("run_id", "name", "scope_id").orderBy("seq")
    e = events.filter(F.col("kind").isin("def", "access") & F.col("name").isNotNull())
    e = e.withColumn("range_no", F.sum((F.col("kind") == "def").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.filter("range_no > 0").groupBy("run_id", "name", "scope_id", "range_no").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))


def colour(ranges: DataFrame, group: list[str], start: str, end: str, kind: str) -> DataFrame:
    """Ranges with `colour`: in order of start, the smallest number of the same kind free since strictly before it.

    One task per group; groups are single functions.
    """
    import heapq

    import pandas as pd

    schema = ", ".join(f"{c} {t}" for c, t in ranges.dtypes) + ", colour int"

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end], kind="stable").reset_index(drop=True)
        free: dict[str, list[int]] = {}
        busy: list[tuple[int, str, int]] = []
        out, used = [], 0
        for s, e, k in zip(pdf[start], pdf[end], pdf[kind]):
            while busy and busy[0][0] < s:
                _, kk, c = heapq.heappop(busy)
                heapq.heappush(free.setdefault(kk, []), c)
            if free.get(k):
                c = heapq.heappop(free[k])
            else:
                c, used = used, used + 1
            heapq.heappush(busy, (e, k, c))
            out.append(c)
        return pdf.assign(colour=pd.Series(out, dtype="int32"))

    return ranges.groupBy(*group).applyInPandas(paint, schema)


def slice_without(edges: DataFrame, seeds: DataFrame, items: DataFrame, cutoff: DataFrame) -> DataFrame:
    """(run_id, root, node, depth): a slice in two passes that leaves out what may be rebuilt otherwise.

    cutoff: (run_id, obj_id, latest). The first pass reaches everything; reached items that evaluate to an object and end
    no later than its cut-off are barred in the second.
    """
    first = reachable(edges, seeds)
    known = first.select("run_id", "node").distinct().join(items.select("run_id", F.col("item_id").alias("node"), "obj_id", "end_time"), ["run_id", "node"]).join(cutoff, ["run_id", "obj_id"])
    barred = known.filter(F.col("end_time") <= F.col("latest")).select("run_id", "node").distinct()
    return reachable(edges, seeds.join(barred, ["run_id", "node"], "left_anti"), barred)


def latest_cutoff(points: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Each point (`start_time`) with the latest end of an item of the same key that is over by then, as `latest`."""
    from quillstone.operators.joins import asof

    over = items.select(*by, F.col("end_time").alias("start_time"), F.col("end_time").alias("latest"))
    return asof(points, over, "start_time", by, ["latest"]).drop("right_start_time")


def object_dependence(items: DataFrame, events: DataFrame, deps: DataFrame, resolvers: DataFrame, width: int) -> DataFrame:
    """(run_id, item_id, obj_ids): objects read in an item or in any item that its external dependencies lead to.

    From a dependency the way goes on to its earliest-ending resolver; objects come sorted and once.
    """
    i = items.select("run_id", "item_id", F.struct("end_time", "start_time", "item_id").alias("o"))
    ext = item_dependencies(items, deps, width).filter("side = 'external'")
    to = resolvers.join(i, ["run_id", "item_id"]).groupBy("run_id", "src_seq", "dst_seq").agg(F.min("o").alias("o")).select("run_id", "src_seq", "dst_seq", F.col("o.item_id").alias("next"))
    edges = ext.join(to, ["run_id", "src_seq", "dst_seq"]).select("run_id", F.col("item_id").alias("node"), "next").distinct()
    reach = reachable(edges, items.select("run_id", F.col("item_id").alias("node"))).select("run_id", "root", "node")
    reads = enveloping_items(events.filter((F.col("kind") == "read") & F.col("obj_id").isNotNull()).select("run_id", "obj_id", F.col("ts").alias("t")), items, width).select("run_id", F.col("item_id").alias("node"), "obj_id").distinct()
    return reach.join(reads, ["run_id", "node"]).groupBy("run_id", F.col("root").alias("item_id")).agg(F.array_sort(F.collect_set("obj_id")).alias("obj_ids"))


def merge_ranges(ranges: DataFrame, copies: DataFrame) -> DataFrame:
    """Live ranges joined where one is only handed on: at `x = y` the range of x continues that of y if y is not used later.

    ranges: as live_ranges. copies: (run_id, scope_id, def_seq, access_seq), the definition of x and the access to y in
    one assignment. Returns (run_id, name, scope_id, range_no, root_seq), root_seq being the start of the first range of
    the chain. A range continues at most one and is continued by at most one; chains are shortened by pointer doubling.
    """
    key = ["run_id", "scope_id"]
    a = ranges.select(*key, F.col("end_seq").alias("access_seq"), F.col("start_seq").alias("before"))
    up = copies.select(*key, "def_seq", "access_seq").join(a, [*key, "access_seq"]).groupBy(*key, "def_seq").agg(F.min("before").alias("before"))
    # a definition may serve as an access of another name at the same time; what is defined there is one range
    link = ranges.select(*key, "start_seq").distinct().join(up.withColumnRenamed("def_seq", "start_seq"), [*key, "start_seq"], "left")
    link = materialize(link.select(*key, "start_seq", F.coalesce(F.when(F.col("before") < F.col("start_seq"), F.col("before")), F.col("start_seq")).alias("root")), "mrg")
    for _ in range(64):  # a chain of 2^64 ranges at most
        to = link.select(*key, F.col("start_seq").alias("root"), F.col("root").alias("next"))
        now = materialize(link.join(to, [*key, "root"]).select(*key, "start_seq", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "mrg")
        link = now.drop("moved")
        if now.filter("moved").isEmpty():
            break
    return ranges.join(link, [*key, "start_seq"]).select("run_id", "name", "scope_id", "range_no", F.col("root").alias("root_seq"))
