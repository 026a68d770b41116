import pytest
from pyspark.sql import functions as F

from quillstone.operators import descriptions as ds, mining
from quillstone.sources.store import KeyedStore


def test_prompts_and_candidates(spark):
    tasks = spark.createDataFrame([(1, "x = 1", "k"), (2, "y", "none")], "task_id int, code string, kind string")
    ex = spark.createDataFrame([("k", f"c{i}", f"t{i}", i) for i in range(5)], "kind string, code string, text string, i int")
    got = {r.task_id: r.prompt for r in ds.prompts(tasks, ex, "i", "Head", 2).collect()}
    assert got[1] == "Head\n\nCode:\nc0\nDescription: t0\n\nCode:\nc1\nDescription: t1\n\nCode:\nx = 1\nDescription:" and got[2] == "Head\n\nCode:\ny\nDescription:"
    c = spark.createDataFrame([(1, 0, " b "), (1, 1, "a"), (1, 2, "b"), (1, 3, " "), (2, 0, None)], "prompt_id int, candidate int, text string")
    assert {r.prompt_id: r.texts for r in ds.candidates(c).collect()} == {1: ["b", "a"]}
    r = spark.createDataFrame([("* one\n* two\n* ",)], "t string").select(ds.bullets(F.col("t")).alias("b")).first().b
    assert (r.primary, r.auxiliary) == ("one", ["two", "*"]) or (r.primary, r.auxiliary) == ("one", ["two"])


def test_verification(spark):
    df = spark.createDataFrame([("a", "x", True, True), ("a", "y", False, True), ("b", "z", False, True), ("c", "w", None, False)], "k string, t string, s boolean, l boolean")
    got = {(r.k, r.t, r["mode"]) for r in ds.strict_then_lenient(df, "k", F.col("s"), F.col("l")).collect()}
    assert got == {("a", "x", "strict"), ("b", "z", "lenient")}
    out = {r.k: (r.success, r.failed) for r in ds.outcomes(df, "k", "t", F.col("s")).collect()}
    assert out == {"a": (["x"], ["y"]), "b": ([], ["z"]), "c": ([], ["w"])}
    assert {r.k: r.solved for r in ds.solved(df, "k", "s").collect()} == {"a": True, "b": False, "c": False}


def test_diverse_and_transfer(spark):
    df = spark.createDataFrame([(1, "A  b", 0), (1, "a b ", 1), (1, "c", 2), (2, "a b", 0)], "k int, t string, i int")
    assert sorted((r.k, r.i) for r in ds.diverse(df, "k", "t", "i").collect()) == [(1, 0), (1, 2), (2, 0)]
    done = spark.createDataFrame([(1, "df.head(INT1)", "df.head(5)", "the first 5 rows")], "item_id int, template string, code string, description string")
    items = spark.createDataFrame([(1, "df.head(INT1)", "df.head(5)"), (2, "df.head(INT1)", "df.head(7)"), (3, "df.head(INT1)", "df.tail(7)"), (4, None, "x")], "item_id int, template string, code string")
    assert [(r.item_id, r.description, r.is_derived) for r in ds.transfer(done, items).collect()] == [(2, "the first 7 rows", True)]


def test_token_prefix_and_variants(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "x", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r.n for r in df.select(ds.top_token_prefix(F.col("x"), F.col("y")).alias("n")).collect()] == [2, 0]
    p = spark.createDataFrame([("c2", "say 'x'"), ("c1", 'say "x"')], "code string, text string")
    assert {r.text: r.code for r in ds.quote_variants(p, "code", "text").collect()} == {"say 'x'": "c2", 'say "x"': "c1", "say x": "c1"}


def test_snippets():
    got = mining.snippets("import pandas as pd\nx = df[df['a'] > 1].groupby('b').sum()\nplot(df)\ny = x.head(3)\nz = 5")
    assert [(r["kind"], r["code"]) for r in got] == [("DF_EXPR", "df[df['a'] > 1].groupby('b').sum()"), ("CALLED_W_PD_ARGS", "plot(df)"), ("DF_EXPR", "x.head(3)")]
    assert mining.snippets("x = (") == [] and mining.snippets("") == []


def test_campaign_resumes(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", "k int, v int")
    keys = lambda s: s.createDataFrame([(i,) for i in range(5)], "k int")
    c = mining.Campaign(keys, lambda s, todo: todo, lambda t: t.withColumn("v", F.col("k") * 2))
    assert c.run(spark, store) == 5 and c.run(spark, store) == 0 and store.read().count() == 5


def test_chain_keeps_columns(spark):
    df = spark.createDataFrame([(1, 2)], "k int, a int")
    assert mining.chain(df, [lambda x: x.withColumn("b", F.lit(1)), lambda x: x.withColumn("c", F.col("b"))], "k").columns == ["k", "a", "b", "c"]
    with pytest.raises(ValueError):
        mining.chain(df, [lambda x: x.drop("a")], "k")


def test_source_class(spark):
    u = ["https://k.example/c/x", "https://k.example/datasets/o/x", "https://k.example/code/o/x", "https://z", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(u)], "i int, u string")
    assert [r.c for r in df.orderBy("i").select(mining.source_class(F.col("u")).alias("c")).collect()] == ["COMPETITION", "DATASET", "KERNEL_OUTPUT", "UNKNOWN", None]


def test_small_operators(spark):
    from quillstone.functions import code
    from quillstone.operators import corpus

    h = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, False, False])] + [("b", 0, False), ("b", 1, True), ("c", 0, False)], "g string, t int, ok boolean")
    assert {(r.g, r.blocked_until) for r in corpus.penalised(h, "g", "ok", "t", 3, 50).collect()} == {("a", 53)}
    base = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, s boolean")
    run = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    assert {r.k for r in corpus.unsolved(base, run, "k", "s").collect()} == {2, 3}
    z = corpus.zip_results(run, spark.createDataFrame([(2, "x")], "k int, r string"), "k")
    assert {(r.k, r.r) for r in z.collect()} == {(1, None), (2, "x"), (3, None), (4, None)}
    assert code.context_variables("n = 5\nimport numpy as np\nnp.f(df.head(n))", ["df"]) == {"n": "int"} and code.context_variables("df.head(m)", ["df"]) is None
    assert code.lift_columns("df['new'] = df['a'] + df['b']\ndf[['a', 'b']]", ["a", "b"]) == ("df[new_col1] = df[col1] + df[col2]\ndf[columns]", {"new_col1": "'new'", "col1": "'a'", "col2": "'b'", "columns": "['a', 'b']"})
    assert code.is_instantiation("f(P)", "f(3)", ["P"], "call with P") and not code.is_instantiation("f(P)", "f(3)", ["P"], "call with PX")
    assert code.top_tokens(["ab", "c", "de"], [["1"], ["2"], ["3"]], 1, 3) == [["1"], ["2"]]
    cells = spark.createDataFrame([([("code", "x"), ("code", " "), ("markdown", "y")],)], "c array<struct<cell_type:string,source:string>>")
    assert [c.source for c in cells.select(mining.code_cells(F.col("c")).alias("c")).first().c] == ["x"]
    u = spark.createDataFrame([(["https://k/c/one", "https://k/datasets/o"],), (["https://k/c/a", "https://k/c/b"],)], "u array<string>")
    assert [r.a for r in u.select(mining.associated_competition(F.col("u")).alias("a")).collect()] == ["https://k/c/one", None]
    mining.registered("t_once")(len)
    with pytest.raises(KeyError):
        mining.registered("t_once")(len)
