import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillstone.functions import code, dates, text
from quillstone.sources import store
from quillstone.streaming import streams

WORDS = ["", " a  b ", "hello-world they're", "ABC", "abc1", "Ünï", "-42", "+7", "x=y=z", "¼²", "\t", "12345678"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)] + [(99, None)], "i int, w string"), pd.Series(WORDS)


def _col(df, expr):
    return [r.x for r in df.filter("w is not null").select("i", expr.alias("x")).orderBy("i").collect()]


def test_strings_like_pandas(words):
    df, s = words
    w = F.col("w")
    assert _col(df, text.split_words(w)) == s.str.split().tolist()
    assert _col(df, text.pad(w, 7)) == s.str.pad(7).tolist() and _col(df, text.pad(w, 6, "right", "*")) == s.str.pad(6, "right", "*").tolist()
    assert _col(df, text.zfill(w, 5)) == s.str.zfill(5).tolist()
    assert _col(df, text.find(w, "b")) == s.str.find("b").tolist() and _col(df, text.rfind(w, "=")) == s.str.rfind("=").tolist()
    assert _col(df, text.slice_text(w, -3)) == s.str.slice(-3).tolist() and _col(df, text.slice_text(w, 1, -1)) == s.str.slice(1, -1).tolist()
    assert _col(df, text.capitalize(w)) == s.str.capitalize().tolist() and _col(df, text.title(w)) == s.str.title().tolist()
    assert _col(df, text.swapcase(w)) == s.str.swapcase().tolist()
    assert [tuple(x) for x in _col(df, text.partition(w, "="))] == s.str.partition("=").apply(tuple, axis=1).tolist()
    assert [tuple(x) for x in _col(df, text.rpartition(w, "="))] == s.str.rpartition("=").apply(tuple, axis=1).tolist()
    assert _col(df, text.rsplit(w, "=", 1)) == s.str.rsplit("=", n=1).tolist()
    assert _col(df, text.extract(w, "([a-z])=")) == [None if pd.isna(x) else x for x in s.str.extract("([a-z])=")[0]]
    for c in ("isalnum", "isalpha", "isdigit", "isdecimal", "isnumeric", "isspace", "islower", "isupper"):
        assert _col(df, text.is_class(w, c)) == getattr(s.str, c)().tolist(), c


def test_dates_like_pandas(spark):
    days = pd.Series(pd.to_datetime(["2024-01-01", "2024-02-29 13:37:11.25", "2023-12-31 23:59:59", "2023-03-31", "2021-07-04 00:07:30", "2000-10-01"], format="ISO8601"))
    df = spark.createDataFrame([(i, str(d)) for i, d in enumerate(days)], "i int, s string").withColumn("t", F.col("s").cast("timestamp_ntz"))
    col = lambda e: [r.x for r in df.select("i", e.alias("x")).orderBy("i").collect()]
    for k, e in dates.parts(F.col("t")).items():
        want = days.dt.isocalendar().week if k == "week" else getattr(days.dt, k)
        assert col(e) == want.tolist(), k
    for k, e in dates.flags(F.col("t")).items():
        assert col(e) == getattr(days.dt, k).tolist(), k
    assert col(dates.strftime(F.col("t"), "%Y-%m-%d at %H:%M, %b")) == days.dt.strftime("%Y-%m-%d at %H:%M, %b").tolist()
    for f, n in ((dates.floor_to, "floor"), (dates.ceil_to, "ceil"), (dates.round_to, "round")):
        assert col(f(F.col("t"), 900)) == [x.to_pydatetime() for x in getattr(days.dt, n)("15min")]
    assert col(dates.month_end(F.col("t"))) == [(x + pd.offsets.MonthEnd(1)).date() for x in days]
    assert col(dates.add_business_days(F.col("t"), 3)) == [(x + pd.offsets.BDay(3) if x.weekday() < 5 else x - pd.offsets.BDay(1) + pd.offsets.BDay(3)).date() for x in days]
    assert [str(r.e) for r in spark.createDataFrame([(2023,), (2024,), (2038,)], "y int").select(dates.easter(F.col("y")).alias("e")).collect()] == ["2023-04-09", "2024-03-31", "2038-04-25"]


# -- code


def test_normal_forms():
    assert code.normal_form("x=(1)\n\n\ny = 'a'") == 'x = 1\ny = \'a\'' and code.normal_form("x = (") is None
    assert code.drop_self_assignments("x = x\nif a:\n    y = y") == "if a:\n    pass"
    assert code.sort_keywords("f(b=1, a=2, **k)") == "f(a=2, b=1, **k)"
    assert code.positional_to_keyword("df.head(5); g(1, 2)", {"head": ["n"]}) == "df.head(n=5)\ng(1, 2)"
    assert code.attributes_to_subscripts("df.Price.mean() + df.shape[0] + x.Price", ["df"]) == "df['Price'].mean() + df.shape[0] + x.Price"
    assert code.canonical_variables("b = a.merge(c)", ["a", "c"]) == "b = df1.merge(df2)"
    assert code.propagate_constants("n = 5\nm = [1]\nm.append(2)\nf(n, m)") == "n = 5\nm = [1]\nm.append(2)\nf(5, m)"
    assert code.equivalent("f(b=['x'], a=1)", "f(a=1, b='x')") and not code.equivalent("f(", "f(")


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["f(b=1, a=2)", "x = [1, 2]\ny = x.a", "if a:\n  b = 1", "df.A + df.b", "lambda x: x + 1", "@d\ndef f(a, *b): return {1: a}"]))
def test_forms_are_idempotent(src):
    for f in (code.normal_form, code.sort_keywords, code.comparison_form, code.drop_self_assignments):
        assert f(f(src)) == f(src)


def test_templates_and_unification():
    t, params = code.template("df[df['a'] > 3].isin([1, 2]) + df['a']", ["df"])
    assert t == "DF1[DF1[STR1] > INT1].isin(INT_LIST1) + DF1[STR1]" and params == {"DF1": "df", "STR1": "'a'", "INT1": "3", "INT_LIST1": "[1, 2]"}
    assert code.instantiate(t, params) == "df[df['a'] > 3].isin([1, 2]) + df['a']"
    assert code.unify("f(P, P)", "f(1, 1)", ["P"]) == {"P": "1"} and code.unify("f(P, P)", "f(1, 2)", ["P"]) is None and code.unify("f(1)", "f(1)", ["P"]) is None
    assert code.parameterise("df.nlargest(10, 'price')", "the 10 rows with the largest price") == {"PARAM_1": "10", "PARAM_2": "price"}


def test_deltas_and_nodes():
    assert code.line_diff("a\nb\nc", "a\nx\nc") == "-b\n+x"
    assert code.blank_out("a\nb", "a\nx\ny") == ("a\n<blank 1>", ["x\ny"])
    refs = code.removable_keywords("plot(x, c='r', s=n)", {"plot": {"c", "s"}})
    assert refs == [("keyword", 0)] and code.remove_nodes("plot(x, c='r', s=n)", refs) == "plot(x, s=n)"
    assert code.undefined_names("import a\nb = a.f(c)\ndef g(d): return d + e + len(b)") == ["c", "e"]
    n = code.ast_nodes("x = f(1)")
    assert [r["node_type"] for r in n] == ["Module", "Assign", "Name", "Call", "Name", "Constant"] and n[4]["parent_id"] == 3 and n[4]["ordinal"] == 1
    assert [(r["name"], r["role"]) for r in code.definitions_and_uses("def f(a):\n    return a + b\nf(1)")] == [("f", "def"), ("a", "def"), ("a", "access"), ("b", "access"), ("f", "access")]
    assert code.library_usages("import pandas as pd\nfrom a.b import c as e\nimport os\npd.x(e)") == {"e": "a.b.c", "pd": "pandas"}
    assert code.call_names("import numpy as np\nnp.a.b(f(x))") == ["numpy.a.b", "f"]
    assert "".join(code.tokens("a 'b c'  d")) == "a 'b c'  d" and code.constant_value("{'a': [1, (2,)]}") == "{'a': [1, (2,)]}" and code.constant_value("f()") is None


def test_notebooks_and_pages(spark):
    import json

    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "markdown", "source": "text"}, {"cell_type": "code", "source": "c"}]})
    df = spark.createDataFrame([(1, nb), (2, "{"), (3, None)], "id int, j string")
    got = [(r.id, r.cell_no, r.cell_type, r.source) for r in code.notebook_cells(df, "id", "j").orderBy("id", "cell_no").collect()]
    assert got == [(1, 0, "code", "a = 1\nb"), (1, 1, "markdown", "text"), (1, 2, "code", "c")]
    assert [r.script for r in code.notebook_script(df, "id", "j").collect()] == ["a = 1\nb\nc"]
    assert code.strip_magics("%matplotlib inline\nx = 1\n!ls\ny?") == "x = 1" and code.strip_magics("%%bash\nls") == ""
    cells = code.html_cells("<html><script>bad()</script><p>Hi &amp; bye</p><pre>x = 1\ny</pre><div>z</div></html>")
    assert [(c["kind"], c["content"]) for c in cells] == [("text", "Hi & bye"), ("code", "x = 1\ny"), ("text", "z")]


# -- sources and streams


def test_keyed_store(spark, tmp_path):
    s = store.KeyedStore(spark, str(tmp_path / "s"), "k", "k string, v int")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert s.read().count() == 0
    s.insert(rows(("10", 10), ("20", 20)))
    s.insert(rows(("30", 30)))
    with pytest.raises(KeyError):
        s.insert(rows(("20", 1)))
    with pytest.raises(KeyError):
        s.insert(rows(("40", 1), ("40", 2)))
    s.insert_missing(rows(("30", 99), ("40", 40)))
    assert {r.k: r.v for r in s.read().collect()} == {"10": 10, "20": 20, "30": 30, "40": 40}
    assert [r.v for r in s.get(["20"]).collect()] == [20] and s.lookup(rows(("10", 0))).count() == 1
    s.clear()
    assert s.read().count() == 0


def test_ordered_list(spark, tmp_path):
    o = store.OrderedList(spark, str(tmp_path / "o"), "value int")
    for part in ([10, 20, 30], [40, 50, 60]):
        o.append(spark.createDataFrame([(x,) for x in part], "value int"), ["value"])
    assert [r.value for r in o.read().orderBy("ord").collect()] == [10, 20, 30, 40, 50, 60] and [r.value for r in o.at([4]).collect()] == [50]


def test_flat_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("ab  12\ncd    \n")
    assert [tuple(r) for r in store.read_fixed_width(spark, str(tmp_path / "f.txt"), {"a": (0, 2), "n": (2, 6)}).collect()] == [("ab", "12"), ("cd", None)]
    (tmp_path / "f.csv").write_text("a,b\n1,x\n,y\n")
    assert [tuple(r) for r in store.read_csv(spark, str(tmp_path / "f.csv"), "a int, b string", ["a"]).collect()] == [(1,), (None,)]
    df = spark.createDataFrame([(1, (2, (3,)), [(4,), (5,)])], "a int, s struct<b:int,t:struct<c:int>>, r array<struct<d:int>>")
    assert store.flatten(df).columns == ["a", "s.b", "s.t.c", "r"] and [tuple(r) for r in store.explode_records(df, "r", ["a"]).collect()] == [(1, 4), (1, 5)]


def test_streams_equal_batch(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, "write" if i % 5 == 0 else "read", float(i)) for i in range(60)]
    schema = "seq long, ts timestamp, obj_id long, kind string, value double"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = lambda: streams.read_files(spark, str(tmp_path / "in"), schema, 100)
    got = sorted((r.obj_id, r.src_seq, r.dst_seq) for r in streams.run_once(streams.dependencies(src()), str(tmp_path / "o1"), str(tmp_path / "c1")).collect())
    last, want = {}, []
    for i, _, o, k, _ in rows:
        if k == "write":
            last[o] = i
        elif o in last:
            want.append((o, last[o], i))
    assert got == sorted(want)
    hours = streams.run_once(streams.tumbling(src(), "ts", "1 hour", "1 hour", ["kind"], "value"), str(tmp_path / "o2"), str(tmp_path / "c2"), "complete")
    assert sum(r.n for r in hours.collect()) == 60
    doubled = spark.createDataFrame(rows + rows[:10], schema)
    doubled.write.parquet(str(tmp_path / "in2"))
    once = streams.run_once(streams.keep_once(streams.read_files(spark, str(tmp_path / "in2"), schema), ["seq"], "ts", "1 day"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert once.count() == 60
    q = streams.append_to(src(), str(tmp_path / "out"), str(tmp_path / "c4"))
    q.awaitTermination()
    streams.append_to(src(), str(tmp_path / "out"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
