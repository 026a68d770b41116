import ast
import json
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from quillstone.llm import formats, jsonsyntax, parse, pysyntax

GOOD = [
    "", "\n# only a comment\n", "x = 1", "a: int = 3; b += 1", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a\n", "for x, *y in z: pass\nelse:\n  pass",
    "try:\n  a\nexcept* E as e:\n  b\nfinally:\n  c", "with (a as b, c as d):\n  pass", "with (a): pass", "match x:\n  case {'a': 1, **r} if r: pass\n  case A(b, c=[1, *_]) | None: pass",
    "match = 1; case = match", "type X[T] = list[T]", "f'{a!r:>{w}} {b=}' f\"{d['k']}\"", "x = [i for i in y if i]", "f(*a, b=1, **c)", "(yield)", "@d\nclass A(B, m=c):\n  x = 1",
    "lambda *a, b=1: a", "print(x := 1)", "a = b = c", "del (a), b[0]", "if a:\n\tb\n", "x = (1,\n  2)\ny = 3", "async def f():\n  async with a: await b", "0xFF + 1_000 + 1e5j", "a if b else c, d",
]
BAD = [
    "x = ", "print x", "def f(:\n  pass", "if a\n  b", "f(a=1, 2)", "x = (1,", "x)", "for x in y:\nz", "  x", "if a:\n    b\n  c", "1 = x", "f() = 1", "a.b: int: c", "x = 'abc", "<<<<<<< HEAD", "else:\n  x",
    "try:\n  x\ny", "@d\nx", "f(x for x in y, z)", "{1: 2, 3}", "def f(a=1, b): pass", "import a.", "from . import", "f'{a'", "f'{}'", "f'}'", "b'é'", "b'a' 'b'", "'\\x1'", "a ? b", "0777", "lambda: (yield) = 1",
    "match x:\n  y", "case 1: pass", "del f()", "a +", "not", "async x", "x = ‘a’", "[x for *y]", "(*a)", "[*a for a in b]", "nonlocal", "raise a from", "assert", "f(a.b=1)", "with a as 1: pass", "SELECT a, count(*) AS b", "x = 1\n\\",
]


@pytest.mark.parametrize("src", GOOD)
def test_accepts(src):
    ast.parse(src)
    assert pysyntax.errors_of(src) == []


@pytest.mark.parametrize("src", BAD)
def test_rejects(src):
    with pytest.raises((SyntaxError, ValueError)):
        ast.parse(src)
    assert pysyntax.errors_of(src)


def test_recovers_and_reports_all():
    found = pysyntax.errors_of("a = \nb = 1\nif x:\n    y = )\nz = 3\nprint q\n")
    assert [a for a, _ in found] == [1, 4, 6]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_mutants_agree_with_python(seed):
    r = random.Random(seed)
    tokens = re.findall(r"\s+|\w+|[^\w\s]", "\n".join(r.sample(GOOD, 2)))
    for _ in range(r.randint(1, 3)):
        i = r.randrange(len(tokens)) if tokens else 0
        if tokens and r.random() < 0.5:
            del tokens[i]
        else:
            tokens.insert(i, r.choice(["(", ")", ",", ":", "=", "*", " if ", " for ", " in ", "\n", " x ", "1", "'", "."]))
    src = "".join(tokens)
    try:
        ast.parse(src)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    if not valid:
        assert pysyntax.errors_of(src), src
    assert (not parse.python_errors(src)) == valid


@pytest.mark.parametrize("text", ["{}", "[]", ' {"a": [1, -2.5e+3, true, null, "\\u00e9"]}\n', "1", '""', "", "{", "[1,]", '{"a":1,}', "{a:1}", "[01]", "NaN", "[1 2]", '"a\nb"', "{} x", '{"a"}', "[-]", "\ufeff{}", "[1.]", "'a'", "[.5]", "nul"])
def test_json_like_strict_reader(text):
    try:
        json.loads(text, parse_constant=parse._no_constant)
        valid = True
    except ValueError:
        valid = False
    assert (not jsonsyntax.errors_of(text)) == valid


def test_json_reports_all():
    assert [a for a, _ in jsonsyntax.errors_of('{"a": ,\n "b": 1,\n c: 2,\n "d": [1,, 2]}')] == [1, 3, 4]


def _nb(*sources):
    return json.dumps({"cells": [{"cell_type": "code", "source": s} for s in sources] + [{"cell_type": "markdown", "source": "not python ("}]})


def test_files(spark):
    rows = [
        (1, "o/a", _nb(["%matplotlib inline\n", "x = 1\n", "  !ls (\n"], "%%bash\nls |"), "a.IPYNB", "e"), (2, "o/b", _nb("x = ("), "b.ipynb", "e"), (3, "O/c", "x = 1", "c.PY", "e"), (4, None, "{", "d.json", "e"),
        (5, "p", None, "e.py", "e"), (6, "p/f", "(", "f.txt", "e"), (7, "p/g", "{}", "g.ipynb", "e"), (8, "p/h", "", "h.json", "e"), (9, "p/i", "", "i.py", "e"), (9, "p/i", "", "i.py", "e"), (10, "p/j", "x = 1\n" * 30_000 + "y = )", "j.py", "e"), (None, "p/k", "x", None, "e"),
    ]
    df = spark.createDataFrame(rows, "task_id long, base_uid string, nb_json string, path string, errors string")
    checked = parse.check_files(df, "mining_tasks", "task_id", "base_uid", "nb_json", "path")
    got = {r.row_id: r for r in parse.once(checked).collect()}
    assert {i for i, r in got.items() if r.first_cause} == {2, 4, 7, 8, 10} and set(got) == {1, 2, 3, 4, 7, 8, 9, 10}
    assert got[10].first_line == 30_001 and got[3].owner == "O" and got[4].owner is None
    rate = {(r.owner, r.language): (r.n_files, r.n_broken) for r in parse.rates(checked).collect()}
    assert rate["o", "notebook"] == (2, 1) and rate["p", "python"] == (2, 1)
    assert parse.rates(parse.check_files(df.limit(0), "t", "task_id", "base_uid", "nb_json", "path")).collect() == []


def test_canonical_words():
    same = lambda a, b: formats.canonical_words(a) == formats.canonical_words(b)
    assert same("f(a, x=1, y=g(q=2, p=3))", "F( a,Y = g(p=3,q=2) ,\r\n x=1 )")
    assert same("d = {'a': 1, 'b': {2: 3, 4: 5}}", 'd={"b":{4:5,2:3},"a":1}')
    assert not same("f(a, b)", "f(b, a)") and not same("def f(a=1, b=2): pass", "def f(b=2, a=1): pass")
    assert not same("{a, b}", "{b, a}") and not same("[a, b]", "[b, a]") and not same("x = 1; y = 2", "y = 2; x = 1")
    assert same("f(s='a,(b', t=1)", "f(t=1, s='a,(b')") and same("f(t=1, s=2", "f(t=1, s=2")
    assert not same("f(x==1, y)", "f(y, x==1)")


@pytest.mark.parametrize("hot", [None, 5])
def test_copies_equal_brute_force(spark, hot):
    rows = [(100 + i, "f(a=1, b=2)" if i % 2 else "F(b=2,  a=1)") for i in range(12)] + [(1, "x = y"), (2, "X=Y"), (2, "X=Y"), (3, "y = x"), (4, None), (5, "  "), (None, "x = y"), (7, "-"), (8, "...")]
    df = spark.createDataFrame([(a, b, "k") for a, b in rows], "rec_id long, code string, key string").repartition(3)
    members, groups = formats.copy_groups(df, "rec_id", "code", hot)
    assert {tuple(r) for r in groups.collect()} == {(100, 12), (1, 2), (7, 2)}
    assert sorted(tuple(r) for r in members.collect()) == sorted([(100, 100 + i) for i in range(12)] + [(1, 1), (1, 2), (7, 7), (7, 8)])
    assert formats.copy_groups(df.limit(0), "rec_id", "code")[1].collect() == []


@pytest.mark.parametrize("code", [r"'\N{foo}'", r"'\N{BULLET}'", r"'\N{bullet}'", r"r'\N{foo}'", r"b'\N{foo}'", r"f'\N{foo}'", r"'\\N{foo}'", r"f'{x}\N{DASH}'", r"f'{x}\N{EM DASH}'", r"'\N{KEYCAP DIGIT ONE}'", r"'\N{}'", r"'\N{BULLET'", r"'\\\N{foo}'"])
def test_named_escapes_as_python_has_them(code):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(code, "", "exec")
            valid = True
        except SyntaxError:
            valid = False
    assert (not parse.python_errors(code)) == valid
