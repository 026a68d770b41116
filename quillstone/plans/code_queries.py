"""Queries of the code functions on written cases: the expected results are the rows of the SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.functions import code as cd
from quillstone.operators import mining
from quillstone.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def cases(name: str, doc: str, f, rows: list[tuple]) -> None:
    """Register (case_no, result) of f over written inputs; the last part of each row is what must come out.

    f takes the inputs of a row and returns text, or what is written as JSON.
    """
    arity = len(rows[0]) - 1

    def text(*x):
        r = f(*x)
        return r if r is None or isinstance(r, str) else json.dumps(r, sort_keys=True)

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "case_no int, " + ", ".join(f"x{i} string" for i in range(arity)))
        return df.select("case_no", cd.udf(text)(*[f"x{i}" for i in range(arity)]).alias("result"))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    want = [(i, r[-1] if r[-1] is None or isinstance(r[-1], str) else json.dumps(r[-1], sort_keys=True)) for i, r in enumerate(rows)]
    ORACLE[name] = "SELECT CAST(case_no AS INT) AS case_no, CAST(result AS VARCHAR) AS result FROM (VALUES " + ", ".join(f"({i}, {_quoted(v)})" for i, v in want) + ") t(case_no, result)"


cases("code_formatting", "C1, C2: one layout for equal code, self assignments removed.", lambda c: cd.drop_self_assignments(c), [
    ("x = x\ny=df [ 'a' ]", "y = df['a']"), ("df = df\ndf = df.dropna( )", "df = df.dropna()"), ("if a:\n    b = b\n    c = 1", "if a:\n    c = 1"), ("def f(:", None),
])
cases("code_keyword_order", "C3: keyword arguments in alphabetical order, unpackings last.", cd.sort_keywords, [
    ("f(b=1, a=2)", "f(a=2, b=1)"), ("df.plot(x, y=1, kind='bar', **kw)", "df.plot(x, kind='bar', y=1, **kw)"), ("f(g(z=1, y=2), c=3, b=4)", "f(g(y=2, z=1), b=4, c=3)"), ("f(", None),
])
_SIGNATURES = {"head": ["n"], "merge": ["right", "how", "on"], "clip": ["/", "lower", "upper"]}
cases("code_positional_to_keyword", "C4, C5, C23: positional arguments named by a table of signatures.", lambda c: cd.positional_to_keyword(c, _SIGNATURES), [
    ("df.head(5)", "df.head(n=5)"), ("df.merge(b, 'left')", "df.merge(right=b, how='left')"), ("df.merge(b, on='k', how='inner')", "df.merge(right=b, how='inner', on='k')"), ("df.merge(*args)", "df.merge(*args)"), ("other(1)", "other(1)"),
])
cases("code_attributes_to_subscripts", "C6: columns as attributes become subscripts.", lambda c: cd.attributes_to_subscripts(c, ["df"]), [
    ("df.Price.mean()", "df['Price'].mean()"), ("df.head()", "df.head()"), ("other.Price", "other.Price"), ("df.total = df.a + df.b", "df['total'] = df['a'] + df['b']"),
])
cases("code_constant_propagation", "C7: names bound once to a literal are replaced by it.", cd.propagate_constants, [
    ("n = 5\ndf.head(n)", "n = 5\ndf.head(5)"), ("n = 5\nn = 6\ndf.head(n)", "n = 5\nn = 6\ndf.head(n)"), ("cols = ['a']\ncols.append('b')\ndf[cols]", "cols = ['a']\ncols.append('b')\ndf[cols]"),
])
cases("code_canonical_variables", "C8: frames renamed in order of appearance.", lambda c: cd.canonical_variables(c, ["sales", "stock"]), [
    ("sales.head()", "df.head()"), ("stock.merge(sales)", "df1.merge(df2)"), ("x = stock\nx + 1", "x = df\nx + 1"),
])
cases("code_library_usages", "C10, C24: libraries by alias.", cd.library_usages, [
    ("import numpy as np\nimport json\nfrom pandas import DataFrame as D\nD(np.ones(3))", {"np": "numpy", "D": "pandas.DataFrame"}), ("x = 1", {}),
])
cases("code_context_variables", "C11: free names with the kind of their value; none if one has no known value.", lambda c: cd.context_variables(c, ["df"]), [
    ("n = 3\ndf.head(n)", {"n": "int"}), ("df.head(k)", None), ("cols = ['a', 'b']\ndf[cols].sum()", {"cols": "list"}),
])
cases("code_equivalence", "C13, C14: equal but for layout, quotes and keyword order.", lambda a, b: "equal" if cd.equivalent(a, b) else "different", [
    ("f(a=1, b=2)", "f( b = 2, a=1 )", "equal"), ("df['a']", 'df["a"]', "equal"), ("df['a']", "df['b']", "different"), ("f(", "f(", "different"),
])
cases("code_unification", "C15, C17: what the parameters of a pattern stand for, consistently.", lambda p, c: cd.unify(p, c, [x for x in ("STR1", "INT1") if x in p]), [
    ("df[STR1].head(INT1)", "df['a'].head(5)", {"STR1": "'a'", "INT1": "5"}), ("df[STR1] + df[STR1]", "df['a'] + df['b']", None), ("df[STR1] + df[STR1]", "df['a'] + df['a']", {"STR1": "'a'"}), ("df.head(INT1)", "df.tail(5)", None),
])
cases("code_instantiation", "C16, C19: patterns filled in, and whether a code is one with a text that names its parameters.", lambda p, c, t: [cd.instantiate(p, {"STR1": "'a'", "INT1": "5"}), cd.is_instantiation(p, c, ["STR1"], t)], [
    ("df[STR1]", "df['a']", "the column STR1", ["df['a']", True]), ("df[STR1]", "df['a']", "the column", ["df['a']", False]), ("df.f(STR1)", "df.g('a')", "STR1", ["df.f('a')", False]),
])
cases("code_parameterised_by_text", "C18: constants that the text names.", cd.parameterise, [
    ("df[df['age'] > 30]", "rows with age above 30", {"PARAM_1": "age", "PARAM_2": "30"}), ("df.head(5)", "the first rows", {}), ("df['a'] + df['a']", "twice the column a", {"PARAM_1": "a"}),
])
cases("code_tokens", "C20: words and quoted parts with the blanks between them; shell words.", lambda t: [cd.tokens(t), cd.shell_words(t)], [
    ("keep  'a b' rows", [["keep", "  ", "'a b'", " ", "rows"], ["keep", "a b", "rows"]]), ("it's", [["it", "'", "s"], None]), ("", [[], []]),
])
cases("code_column_lifting", "C21: columns of a schema as variables.", lambda c: cd.lift_columns(c, ["age", "city"]), [
    ("df['age'].mean()", ["df[col1].mean()", {"col1": "'age'"}]), ("df['old'] = df['age'] > 60", ["df[new_col1] = df[col1] > 60", {"new_col1": "'old'", "col1": "'age'"}]), ("df[['age', 'city']]", ["df[columns]", {"columns": "['age', 'city']"}]),
])
cases("code_call_names", "C22: names of what is called, import aliases resolved.", cd.call_names, [
    ("import pandas as pd\npd.read_csv('x').head()", ["pandas.read_csv"]), ("print(len(x))", ["print", "len"]),
])
cases("code_removals", "C25, C26: nodes named by type and place are removed.", lambda c, r: cd.remove_nodes(c, [tuple(x) for x in json.loads(r)]), [
    ("plot(x, color='r', alpha=1)", '[["keyword", 0]]', "plot(x, alpha=1)"), ("a = 1\nb = 2", '[["Assign", 1]]', "a = 1"), ("if a:\n    b = 1", '[["Assign", 0]]', "if a:\n    pass"),
])
cases("code_removable_keywords", "C27: optional keyword arguments with constant values.", lambda c: cd.removable_keywords(c, {"plot": {"color", "alpha"}}), [
    ("plot(x, color='r', size=3, alpha=1)", [["keyword", 0], ["keyword", 2]]), ("plot(x, color=c)", []), ("other(color='r')", []),
])
cases("code_line_deltas", "C28, C29: removed and added lines; the new code with what differs blanked out.", lambda a, b: [cd.line_diff(a, b), cd.blank_out(a, b)], [
    ("a\nb\nc", "a\nx\nc", ["-b\n+x", ["a\n<blank 1>\nc", ["x"]]]), ("a", "a", ["", ["a", []]]), ("a", "a\nb\nc", ["+b\n+c", ["a\n<blank 1>", ["b\nc"]]]),
])
cases("code_top_tokens", "C31: alternatives of the tokens in a window of characters.", lambda t: cd.top_tokens(json.loads(t), [[x.upper()] for x in json.loads(t)], 2, 5), [
    ('["ab", "cd", "ef"]', [["CD"], ["EF"]]), ('["abcdefg"]', [["ABCDEFG"]]), ("[]", []),
])
cases("code_undefined_names", "C33: names that nothing binds.", cd.undefined_names, [
    ("print(x)", ["x"]), ("x = 1\nprint(x)", []), ("def f(a):\n    return a + b", ["b"]), ("x = (", None),
])
cases("code_constant_values", "C36: literals and operations on them.", cd.constant_value, [
    ("[1, 'a']", "[1, 'a']"), ("x", None), ("-3", "-3"), ("{'a': (1, 2)}", "{'a': (1, 2)}"),
])
cases("code_magics", "A14: notebook magics as comments or nothing; the rest stays.", cd.strip_magics, [
    ("%matplotlib inline\nx = 1", "x = 1"), ("!pip install y\nz = 2", "z = 2"), ("x = 5 % 3", "x = 5 % 3"),
])
cases("mined_expressions", "C12, C39: outermost expressions over frames, with the kind of their result.", lambda c: [[s["code"], s["kind"]] for s in mining.snippets(c)], [
    ("df.groupby('a').sum()", [["df.groupby('a').sum()", "DF_EXPR"]]), ("x = df['a'].mean()", [["df['a'].mean()", "SERIES_EXPR"]]), ("y = 1", []),
])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT task_id, CASE WHEN contains(url, '/c/') OR contains(url, '/competitions/') THEN 'COMPETITION' WHEN contains(url, '/datasets/') THEN 'DATASET' WHEN contains(url, '/code/') OR contains(url, '/kernels/') THEN 'KERNEL_OUTPUT' WHEN url IS NOT NULL THEN 'UNKNOWN' END AS kind, CASE WHEN task_id % 3 = 0 THEN '/c/' || task_id END AS competition FROM (SELECT DISTINCT task_id, CASE task_id % 5 WHEN 0 THEN '/c/x' WHEN 1 THEN '/datasets/y' WHEN 2 THEN '/code/z' WHEN 3 THEN 'other' END AS url FROM mining_tasks)")
def source_classes(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of data sources, the one competition among several sources."""
    t, k = table(spark, d, "mining_tasks", "task_id").distinct(), F.col("task_id")
    url = F.when(k % 5 == 0, "/c/x").when(k % 5 == 1, "/datasets/y").when(k % 5 == 2, "/code/z").when(k % 5 == 3, "other")
    own = F.concat(F.lit("/c/"), k.cast("string"))
    several = F.when(k % 3 == 0, F.array(own, F.lit("/datasets/q"))).when(k % 3 == 1, F.array(own, F.lit("/c/other"))).otherwise(F.array(F.lit("none")))
    return t.select("task_id", mining.source_class(url).alias("kind"), mining.associated_competition(several).alias("competition"))
