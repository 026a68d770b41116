import random

import pytest

from quillstone.operators import joins, trace

EVENT = "run_id long, seq long, ts long, kind string, owner_item_id long, obj_id long, name string, scope_id long, def_event_seq long"
ITEM = "run_id long, item_id long, start_time long, end_time long, scope_id long, item_type string, obj_id long, parent_item_id long"


def _random(seed, n=120):
    r = random.Random(seed)
    items, events = [], []
    for run in (1, 2):
        for i in range(25):
            a = r.randrange(n)
            items.append((run, i, a, a + r.choice([0, 1, 3, 10, 40]), r.randrange(2), r.choice(["statement", "expression"]), r.randrange(4), r.choice([None, *range(i)]) if i else None))
        defs = []
        for s in range(n):
            kind = r.choice(["read", "write", "def", "access", "read"])
            d = r.choice(defs) if kind == "access" and defs and r.random() < 0.8 else None
            events.append((run, s, r.randrange(n), kind, r.choice([None, 1]), r.choice([None, 0, 1, 2]), r.choice(["a", "b"]), r.randrange(2), d))
            if kind == "def":
                defs.append(s)
    return items, events


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    items, events = _random(request.param)
    return items, events, spark.createDataFrame(items, ITEM), spark.createDataFrame(events, EVENT)


def _deps(events):
    out, last, defs = [], {}, {}
    for run, s, ts, kind, _, obj, _, _, d in events:
        if kind == "read" and (run, obj) in last and obj is not None:
            out.append((run, last[run, obj][0], last[run, obj][1], s, ts, "RAW"))
        elif kind == "access" and d is not None:
            out.append((run, d, defs[run, d], s, ts, "DEF_ACCESS"))
        elif kind == "write" and obj is not None:
            last[run, obj] = (s, ts)
        elif kind == "def":
            defs[run, s] = ts
    return out


def _shown(items, events):
    best = {}
    for run, s, ts, kind, owner, _, name, scope, _ in events:
        if kind == "def" and owner is not None:
            for r2, i, a, b, sc, *_ in items:
                if r2 == run and a <= ts < b and sc == scope:
                    best[run, i, name, scope] = max(s, best.get((run, i, name, scope), -1))
    return best


def test_dependencies(case):
    items, events, si, se = case
    got = sorted((r.run_id, r.src_seq, r.src_ts, r.dst_seq, r.dst_ts, r.dep_type) for r in trace.dependencies(se).collect())
    assert got == sorted(_deps(events))


def test_item_dependencies_and_exposure(case):
    items, events, si, se = case
    want = []
    for run, s0, t0, s1, t1, _ in _deps(events):
        for r2, i, a, b, *_ in items:
            if r2 == run and a <= t1 < b and t0 < b:
                want.append((run, i, s0, s1, "external" if t0 < a else "internal"))
    got = sorted(tuple(r) for r in trace.item_dependencies(si, trace.dependencies(se), 7).collect())
    assert got == sorted(want)
    shown = {(r.run_id, r.item_id, r.name, r.scope_id): r.def_seq for r in trace.exposed_definitions(si, se, 7).collect()}
    assert shown == _shown(items, events)


def test_resolvers(case):
    items, events, si, se = case
    shown, want = _shown(items, events), []
    for run, s0, t0, s1, t1, kind in _deps(events):
        for r2, i, a, b, *_ in items:
            if r2 != run:
                continue
            if kind == "RAW" and a <= t0 < b and b <= t1:
                want.append((run, s0, s1, i, "explicit"))
            if kind == "DEF_ACCESS" and b <= t1:
                want += [(run, s0, s1, i, "explicit") for (r3, i3, *_), d in shown.items() if (r3, i3, d) == (run, i, s0)]
            if a <= t0 < b and a <= t1 < b:
                want.append((run, s0, s1, i, "implicit"))
    got = sorted(tuple(r) for r in trace.resolving_items(trace.dependencies(se), si, se, 7).collect())
    assert got == sorted(want)


def test_ancestors_and_statements(case):
    items, _, si, _ = case
    parent = {(i[0], i[1]): i[7] for i in items}
    want = set()
    for (run, i), p in parent.items():
        d = 1
        while p is not None:
            want.add((run, i, p, d))
            p, d = parent[run, p], d + 1
    assert {tuple(r) for r in trace.ancestors(si).collect()} == want
    kind = {(i[0], i[1]): i[5] for i in items}
    own = {}
    for k in parent:
        j = k[1]
        while j is not None and kind[k[0], j] != "statement":
            j = parent[k[0], j]
        if j is not None:
            own[k] = j
    assert {(r.run_id, r.item_id): r.statement_id for r in trace.owning_statements(si).collect()} == own


def test_cycle_raises(spark):
    df = spark.createDataFrame([(1, 1, 0, 1, 0, "s", None, 2), (1, 2, 0, 1, 0, "s", None, 1)], ITEM)
    with pytest.raises(ValueError):
        trace.ancestors(df)


def test_reachable_with_cycles(spark):
    r = random.Random(5)
    edges = {(1, r.randrange(30), r.randrange(30)) for _ in range(50)}
    seeds, barred = {0, 7}, {3}
    want = set()
    for s in seeds:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for _, a, b in edges:
                if a == x and b not in seen and b not in barred:
                    seen.add(b)
                    todo.append(b)
        want |= {(s, x) for x in seen}
    e = spark.createDataFrame(sorted(edges), "run_id long, node long, next long")
    got = trace.reachable(e, spark.createDataFrame([(1, s) for s in seeds], "run_id long, node long"), spark.createDataFrame([(1, 3)], "run_id long, node long"))
    assert {(r.root, r.node) for r in got.collect()} == want


def test_overlaps_once_each(spark):
    r = random.Random(2)
    a = [(i, x, x + r.choice([0, 1, 5, 33])) for i, x in enumerate(r.choices(range(100), k=40))]
    b = [(i, x, x + r.choice([1, 2, 20])) for i, x in enumerate(r.choices(range(100), k=40))]
    got = joins.overlaps(spark.createDataFrame(a, "i int, s1 long, e1 long"), spark.createDataFrame(b, "j int, s2 long, e2 long"), "s1", "e1", "s2", "e2", 8)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((i, j) for i, s, e in a for j, s2, e2 in b if s < e and s2 < e2 and s < e2 and s2 < e)


def test_colouring_never_shares(spark):
    r = random.Random(4)
    rows = [(1, s, s + r.randrange(15), r.choice("xy")) for s in r.sample(range(200), 60)]
    got = trace.colour(spark.createDataFrame(rows, "g long, s long, e long, kind string"), ["g"], "s", "e", "kind").collect()
    for x in got:
        for y in got:
            if x is not y and x.colour == y.colour:
                assert x.kind == y.kind and (x.e < y.s or y.e < x.s)


def test_empty(spark):
    si, se = spark.createDataFrame([], ITEM), spark.createDataFrame([], EVENT)
    assert trace.dependencies(se).collect() == [] and trace.ancestors(si).collect() == [] and trace.live_ranges(se).collect() == []
    assert trace.resolving_items(trace.dependencies(se), si, se, 5).collect() == []


def test_latest_cutoff_and_object_dependence(case, spark):
    items, events, si, se = case
    p = spark.createDataFrame([(1, o, t) for o in range(4) for t in (10, 60, 110)], "run_id long, obj_id long, start_time long")
    got = {(r.obj_id, r.start_time): r.latest for r in trace.latest_cutoff(p, si, ["run_id", "obj_id"]).collect()}
    for (o, t), latest in got.items():
        assert latest == max((i[3] for i in items if i[0] == 1 and i[6] == o and i[3] <= t), default=None)
    deps, by = _deps(events), {(i[0], i[1]): i for i in items}
    res = {}
    for r in trace.resolving_items(trace.dependencies(se), si, se, 7).collect():
        res.setdefault((r.run_id, r.src_seq, r.dst_seq), []).append(r.item_id)
    want = {}
    for run, i in by:
        seen, todo, objs = {i}, [i], set()
        while todo:
            _, _, a, b, *_ = by[run, todo.pop()]
            objs |= {e[5] for e in events if e[0] == run and e[3] == "read" and e[5] is not None and a <= e[2] < b}
            for r2, s0, t0, s1, t1, _ in deps:
                if r2 == run and a <= t1 < b and t0 < a and (run, s0, s1) in res:
                    j = min(res[run, s0, s1], key=lambda k: (by[run, k][3], by[run, k][2], k))
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
        if objs:
            want[run, i] = sorted(objs)
    rd = trace.resolving_items(trace.dependencies(se), si, se, 7)
    got = {(r.run_id, r.item_id): r.obj_ids for r in trace.object_dependence(si, se, trace.dependencies(se), rd, 7).collect()}
    assert got == want


def test_slice_without(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 4)], "run_id long, node long, next long")
    items = spark.createDataFrame([(1, i, i * 10, i * 10 + 5, 0, "statement", i, None) for i in range(1, 5)], ITEM)
    cut = spark.createDataFrame([(1, 2, 30), (1, 4, 10)], "run_id long, obj_id long, latest long")
    got = trace.slice_without(e, spark.createDataFrame([(1, 1)], "run_id long, node long"), items, cut)
    assert {r.node for r in got.collect()} == {1, 4}  # 2 ends by its cut-off, and 3 is reached only through it
