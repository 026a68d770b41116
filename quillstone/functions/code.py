"""Normal forms, templates, unification and deltas of Python code, as Arrow-batched functions over columns.

The plain functions take one code and are what the tests call; `udf` wraps one of them for a column. Code that does not
parse gives null. Nothing is ever executed.
"""

from __future__ import annotations

import ast
import builtins
import difflib
import re
import shlex
import symtable
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def udf(f: Callable, returns: str = "string") -> Callable[..., Column]:
    """`f` of one or more values as a batched column function; null in, null out."""

    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*cols)], dtype=object)

    return run


def _tree(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _text(tree: ast.AST) -> str:
    return ast.unparse(ast.fix_missing_locations(tree))


# -- normal forms


def normal_form(code: str) -> str | None:
    """The code as the unparser writes it."""
    t = _tree(code)
    return None if t is None else _text(t)


class _NoSelfAssign(ast.NodeTransformer):
    def visit_Assign(self, node: ast.Assign):
        if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Name) and node.targets[0].id == node.value.id:
            return None
        return self.generic_visit(node)

    def generic_visit(self, node):
        super().generic_visit(node)
        for field in ("body",):
            if isinstance(getattr(node, field, None), list) and not isinstance(node, ast.Module) and not getattr(node, field):
                setattr(node, field, [ast.Pass()])
        return node


def drop_self_assignments(code: str) -> str | None:
    """Without statements `x = x`; a block that would be empty holds `pass`."""
    t = _tree(code)
    return None if t is None else _text(_NoSelfAssign().visit(t))


class _SortKeywords(ast.NodeTransformer):
    def __init__(self, order: dict[str, int] | None = None):
        self.order = order or {}

    def visit_Call(self, node: ast.Call):
        self.generic_visit(node)
        named = sorted((k for k in node.keywords if k.arg), key=lambda k: (self.order.get(k.arg, len(self.order)), k.arg))
        rest = [k for k in node.keywords if not k.arg]
        node.keywords = named + rest
        return node


def sort_keywords(code: str) -> str | None:
    """Keyword arguments in alphabetical order, unpackings last."""
    t = _tree(code)
    return None if t is None else _text(_SortKeywords().visit(t))


def positional_to_keyword(code: str, signatures: dict[str, list[str]]) -> str | None:
    """Positional arguments named by a table of parameter lists per function name (the last part of a dotted call).

    Naming stops at a starred argument, at a parameter spelled `/` (only positional before it) and at the list's end.
    """
    t = _tree(code)
    if t is None:
        return None
    for node in ast.walk(t):
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else None
            params = signatures.get(name or "")
            if not params or any(isinstance(a, ast.Starred) for a in node.args):
                continue
            only = params.index("/") if "/" in params else 0
            names = [p for p in params if p != "/"]
            keep, named = node.args[:only], node.args[only : len(names)]
            if len(node.args) <= len(names):
                node.keywords = [ast.keyword(arg=n, value=v) for n, v in zip(names[only:], named)] + node.keywords
                node.args = keep
    return _text(_SortKeywords({n: i for i, n in enumerate(n for p in signatures.values() for n in p)}).visit(t))


class _Subscripts(ast.NodeTransformer):
    def __init__(self, frames: set[str], methods: set[str]):
        self.frames, self.methods = frames, methods

    def visit_Attribute(self, node: ast.Attribute):
        self.generic_visit(node)
        if isinstance(node.value, ast.Name) and node.value.id in self.frames and node.attr not in self.methods:
            return ast.Subscript(value=node.value, slice=ast.Constant(node.attr), ctx=node.ctx)
        return node


#: Attributes of a data frame that are no columns.
FRAME_ATTRIBUTES = frozenset(
    "T agg aggregate align all any append apply applymap assign astype at axes between bfill clip columns combine copy corr count cov cummax cummin cumprod cumsum describe diff div dot drop drop_duplicates dropna dtypes duplicated empty eq eval ewm expanding explode ffill fillna filter first get groupby gt head iat idxmax idxmin iloc index info insert interpolate isin isna isnull items iterrows itertuples join keys kurt last le loc lt mask max mean median melt merge min mode mul ndim ne nlargest notna notnull nsmallest nunique pct_change pipe pivot pivot_table plot pop pow prod quantile query rank reindex rename replace resample reset_index rolling round sample select_dtypes sem set_index shape shift size skew sort_index sort_values squeeze stack std sub sum swaplevel tail take to_csv to_dict to_json to_numpy to_parquet transform transpose unstack update value_counts values var where xs".split()
)


def attributes_to_subscripts(code: str, frames: list[str]) -> str | None:
    """`df.Price` as `df['Price']` where df is a frame and Price no attribute of frames."""
    t = _tree(code)
    return None if t is None else _text(_Subscripts(set(frames), set(FRAME_ATTRIBUTES)).visit(t))


def canonical_variables(code: str, frames: list[str]) -> str | None:
    """Frames renamed to df, or df1..n in order of first appearance where there are several."""
    t = _tree(code)
    if t is None:
        return None
    names = [n.id for n in sorted((n for n in ast.walk(t) if isinstance(n, ast.Name) and n.id in frames), key=lambda n: (n.lineno, n.col_offset))]
    seen = list(dict.fromkeys(names))
    new = {s: "df" if len(seen) == 1 else f"df{i}" for i, s in enumerate(seen, 1)}
    for n in ast.walk(t):
        if isinstance(n, ast.Name):
            n.id = new.get(n.id, n.id)
    return _text(t)


def propagate_constants(code: str) -> str | None:
    """Names read at top level replaced by the literal they were last assigned, if they are assigned there only once."""
    t = _tree(code)
    if t is None:
        return None
    stored: dict[str, int] = {}
    changed = set()
    for n in ast.walk(t):
        if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            stored[n.id] = stored.get(n.id, 0) + 1
        if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name):
            changed.add(n.target.id)
        if isinstance(n, (ast.Subscript, ast.Attribute)) and isinstance(n.ctx, (ast.Store, ast.Del)) and isinstance(n.value, ast.Name):
            changed.add(n.value.id)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
            changed.add(n.func.value.id)  # a method may change it
    known: dict[str, ast.expr] = {}

    class Fill(ast.NodeTransformer):
        def visit_Name(self, node: ast.Name):
            return known[node.id] if isinstance(node.ctx, ast.Load) and node.id in known else node

    body = []
    for s in t.body:
        s = Fill().visit(s)
        body.append(s)
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
            name = s.targets[0].id
            if stored.get(name) == 1 and name not in changed and constant_value(ast.unparse(s.value)) is not None:
                known[name] = s.value
    t.body = body
    return _text(t)


def constant_value(code: str) -> str | None:
    """The value of a literal or a container of literals, as its representation; null for anything else."""
    try:
        return repr(ast.literal_eval(code))
    except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
        return None


def library_usages(code: str) -> dict[str, str] | None:
    """Imported names that are used, with what they stand for."""
    t = _tree(code)
    if t is None:
        return None
    full: dict[str, str] = {}
    for n in ast.walk(t):
        if isinstance(n, ast.Import):
            full.update({a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names})
        elif isinstance(n, ast.ImportFrom):
            full.update({a.asname or a.name: f"{'.' * n.level}{n.module or ''}.{a.name}" for a in n.names})
    used = {n.id for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    return {k: v for k, v in sorted(full.items()) if k in used}


def imported_packages(code: str) -> list[str] | None:
    """Top-level packages that are imported, sorted."""
    t = _tree(code)
    if t is None:
        return None
    out = {a.name.split(".")[0] for n in ast.walk(t) if isinstance(n, ast.Import) for a in n.names}
    return sorted(out | {n.module.split(".")[0] for n in ast.walk(t) if isinstance(n, ast.ImportFrom) and n.module and not n.level})


def call_names(code: str) -> list[str] | None:
    """Qualified names of calls in order of place, imports resolved."""
    t = _tree(code)
    if t is None:
        return None
    full = library_usages(code) or {}
    out = []
    for n in sorted((n for n in ast.walk(t) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset, n.end_lineno, n.end_col_offset)):
        parts, f = [], n.func
        while isinstance(f, ast.Attribute):
            parts.append(f.attr)
            f = f.value
        if isinstance(f, ast.Name):
            out.append(".".join([full.get(f.id, f.id), *reversed(parts)]))
    return out


# -- templates and unification


def _kind(v: object) -> str | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        return "STR"
    if isinstance(v, int):
        return "INT"
    if isinstance(v, float):
        return "FLOAT"
    if isinstance(v, (list, tuple)) and v:
        kinds = {_kind(x) for x in v}
        if len(kinds) == 1 and None not in kinds and not any("_LIST" in k for k in kinds):
            return f"{kinds.pop()}_LIST"
    return None


def template(code: str, frames: list[str] | None = None) -> tuple[str, dict[str, str]] | None:
    """(template, parameters): literals and frames as typed placeholders numbered by first appearance.

    Equal text shares a number; a list of literals of one kind is one placeholder.
    """
    t = _tree(code)
    if t is None:
        return None
    names: dict[str, str] = {}
    count: dict[str, int] = {}

    def place(text: str, kind: str) -> ast.expr:
        if text not in names:
            count[kind] = count.get(kind, 0) + 1
            names[text] = f"{kind}{count[kind]}"
        return ast.Name(id=names[text], ctx=ast.Load())

    class Holes(ast.NodeTransformer):
        def visit(self, node):
            if isinstance(node, (ast.Constant, ast.List, ast.Tuple)) and not isinstance(getattr(node, "ctx", None), ast.Store):
                try:
                    kind = _kind(ast.literal_eval(node))
                except (ValueError, TypeError, SyntaxError):
                    kind = None
                if kind:
                    return place(ast.unparse(node), kind)
            if isinstance(node, ast.Name) and frames and node.id in frames:
                new = place(node.id, "DF")
                new.ctx = node.ctx
                return new
            if isinstance(node, ast.JoinedStr):
                return node
            return self.generic_visit(node)

    out = _text(Holes().visit(t))
    return out, {v: k for k, v in names.items()}


def unify(pattern: str, code: str, params: list[str]) -> dict[str, str] | None:
    """What the parameters (names) of a pattern stand for in a code of the same shape; null if it has not that shape.

    A parameter must stand for the same text everywhere, and every one must occur.
    """
    a, b = _tree(pattern), _tree(code)
    if a is None or b is None:
        return None
    bound: dict[str, str] = {}
    wanted = set(params)

    def same(x, y) -> bool:
        if isinstance(x, ast.Name) and x.id in wanted and isinstance(y, ast.expr):
            return bound.setdefault(x.id, ast.unparse(y)) == ast.unparse(y)
        if type(x) is not type(y):
            return False
        if isinstance(x, ast.AST):
            return all(same(getattr(x, f, None), getattr(y, f, None)) for f in x._fields if f not in ("ctx", "kind", "type_comment"))
        if isinstance(x, list):
            return len(x) == len(y) and all(same(p, q) for p, q in zip(x, y))
        return x == y

    return bound if same(a, b) and set(bound) == wanted else None


def instantiate(pattern: str, values: dict[str, str]) -> str:
    """Parameters replaced by their values as whole words, longest names first."""
    if not values:
        return pattern
    names = sorted(values, key=lambda n: (-len(n), n))
    return re.sub(r"\b(?:" + "|".join(map(re.escape, names)) + r")\b", lambda m: values[m.group()], pattern)


def comparison_form(code: str) -> str | None:
    """Sorted keywords and lists of one element unwrapped: equal forms count as equal code."""
    t = _tree(code)
    if t is None:
        return None

    class One(ast.NodeTransformer):
        def visit_List(self, node: ast.List):
            self.generic_visit(node)
            return node.elts[0] if len(node.elts) == 1 and isinstance(node.elts[0], ast.Constant) and isinstance(node.ctx, ast.Load) else node

    return _text(_SortKeywords().visit(One().visit(t)))


def equivalent(a: str, b: str) -> bool:
    x, y = comparison_form(a), comparison_form(b)
    return x is not None and x == y


def parameterise(code: str, text: str) -> dict[str, str] | None:
    """Constants of the code that the text quotes or names, as PARAM_1.. in order of place in the code."""
    t = _tree(code)
    if t is None:
        return None
    out: dict[str, str] = {}
    for n in sorted((n for n in ast.walk(t) if isinstance(n, ast.Constant)), key=lambda n: (n.lineno, n.col_offset)):
        if n.value is None or isinstance(n.value, (bool, bytes)) or n.value is Ellipsis:
            continue
        v = str(n.value)
        if v and v not in out.values() and re.search(rf"(?<!\w){re.escape(v)}(?!\w)", text):
            out[f"PARAM_{len(out) + 1}"] = v
    return out


def tokens(text: str) -> list[str]:
    """Words and quoted parts with the white space between them: joined they give the text again."""
    return re.findall(r"\s+|'[^']*'|\"[^\"]*\"|[^\s'\"]+|['\"]", text)


def shell_words(text: str) -> list[str] | None:
    try:
        return shlex.split(text)
    except ValueError:
        return None


# -- deltas


def line_diff(a: str, b: str) -> str:
    """Removed and added lines (-, +) without context or headers."""
    return "\n".join(x for x in difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=0) if not x.startswith(("---", "+++", "@@")))


def blank_out(a: str, b: str) -> tuple[str, list[str]]:
    """`b` with what differs from `a` as numbered blanks, and their answers."""
    out, answers = [], []
    x, y = a.splitlines(), b.splitlines()
    for tag, _, _, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            out += y[j1:j2]
        elif j2 > j1:
            answers.append("\n".join(y[j1:j2]))
            out.append(f"<blank {len(answers)}>")
    return "\n".join(out), answers


def remove_nodes(code: str, refs: list[tuple[str, int]]) -> str | None:
    """Without the keyword arguments or statements named by (node type, ordinal in walk order)."""
    t = _tree(code)
    if t is None:
        return None
    gone: set[int] = set()
    seen: dict[str, int] = {}
    for n in ast.walk(t):
        k = type(n).__name__
        if (k, seen.get(k, 0)) in refs:
            gone.add(id(n))
        seen[k] = seen.get(k, 0) + 1

    class Cut(ast.NodeTransformer):
        def visit(self, node):
            return None if id(node) in gone and isinstance(node, (ast.keyword, ast.stmt)) else self.generic_visit(node)

    t = Cut().visit(t)
    for n in ast.walk(t):
        if isinstance(getattr(n, "body", None), list) and not n.body and not isinstance(n, ast.Module):
            n.body = [ast.Pass()]
    return _text(t)


def removable_keywords(code: str, optional: dict[str, set[str]]) -> list[tuple[str, int]] | None:
    """References to keyword arguments with a constant value that the table calls optional for the call's name."""
    t = _tree(code)
    if t is None:
        return None
    calls = {}
    for n in ast.walk(t):
        if isinstance(n, ast.Call):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "")
            calls.update({id(k): name for k in n.keywords})
    out, i = [], 0
    for n in ast.walk(t):
        if isinstance(n, ast.keyword):
            if n.arg in optional.get(calls.get(id(n), ""), ()) and constant_value(ast.unparse(n.value)) is not None:
                out.append(("keyword", i))
            i += 1
    return out


def undefined_names(code: str) -> list[str] | None:
    """Names that are read and neither bound anywhere in the code nor built in, sorted."""
    try:
        table = symtable.symtable(code, "code", "exec")
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: set[str] = set()

    def walk(t: symtable.SymbolTable, bound: set[str]) -> None:
        here = bound | {s.get_name() for s in t.get_symbols() if s.is_assigned() or s.is_imported() or s.is_parameter() or s.is_namespace()}
        out.update(s.get_name() for s in t.get_symbols() if s.is_referenced() and s.get_name() not in here and not hasattr(builtins, s.get_name()))
        for c in t.get_children():
            walk(c, here)

    walk(table, set())
    return sorted(out)


NODES = "node_id int, parent_id int, depth int, node_type string, field string, name string, line int, ordinal int"


def ast_nodes(code: str) -> list[dict]:
    """The nodes of a code in pre-order; none if it does not parse. ordinal counts nodes of a type."""
    t = _tree(code)
    out: list[dict] = []
    seen: dict[str, int] = {}

    def walk(n: ast.AST, parent: int | None, depth: int, field: str) -> None:
        k = type(n).__name__
        me = len(out)
        name = getattr(n, "id", None) or getattr(n, "attr", None) or getattr(n, "arg", None) or getattr(n, "name", None)
        out.append({"node_id": me, "parent_id": parent, "depth": depth, "node_type": k, "field": field, "name": name if isinstance(name, str) else None, "line": getattr(n, "lineno", None), "ordinal": seen.get(k, 0)})
        seen[k] = seen.get(k, 0) + 1
        for f, v in ast.iter_fields(n):
            for c in v if isinstance(v, list) else [v]:
                if isinstance(c, ast.AST) and not isinstance(c, ast.expr_context):
                    walk(c, me, depth + 1, f)

    if t is not None:
        try:
            walk(t, None, 0, "")
        except RecursionError:
            return []
    return out


def exploded(df: DataFrame, id_col: str, code_col: str, f: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """(id_col, *schema): the rows that `f` makes of each code."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = df.schema[id_col].dataType.simpleString()
    types = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
    arrow = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, c in enumerate(b.column(1).to_pylist()):
                got = f(c) if c is not None else []
                at += [i] * len(got)
                rows += got
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, arrow)]], names=[id_col, *names])

    return df.select(id_col, code_col).mapInArrow(run, f"{id_col} {kind}, {schema}")


USES = "scope string, name string, role string, line int, seq int"


def definitions_and_uses(code: str) -> list[dict]:
    """Stores and loads of names with the function they are in, in order of place."""
    t = _tree(code)
    out: list[dict] = []

    def walk(n: ast.AST, scope: str) -> None:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append({"scope": scope, "name": n.name, "role": "def", "line": n.lineno, "at": (n.lineno, n.col_offset)})
            inner = f"{scope}.{n.name}" if scope else n.name
            for a in ast.walk(n.args) if hasattr(n, "args") else []:
                if isinstance(a, ast.arg):
                    out.append({"scope": inner, "name": a.arg, "role": "def", "line": a.lineno, "at": (a.lineno, a.col_offset)})
            for c in n.body:
                walk(c, inner)
            return
        if isinstance(n, ast.Name):
            out.append({"scope": scope, "name": n.id, "role": "access" if isinstance(n.ctx, ast.Load) else "def", "line": n.lineno, "at": (n.lineno, n.col_offset)})
        for c in ast.iter_child_nodes(n):
            walk(c, scope)

    if t is not None:
        walk(t, "")
    out.sort(key=lambda r: r["at"])
    return [{k: r[k] for k in ("scope", "name", "role", "line")} | {"seq": i} for i, r in enumerate(out)]


# -- notebooks and pages

_MAGIC = re.compile(r"^\s*(?:%%?\w|!|\?)|\?\s*$")


def strip_magics(code: str) -> str:
    """Without the lines that only a notebook understands; cells in another language become empty."""
    if code.lstrip().startswith("%%"):
        return ""
    return "\n".join(x for x in code.split("\n") if not _MAGIC.search(x))


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[str] = []
        self.text: list[str] = []

    def flush(self, tag: str) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text:
            self.rows.append({"cell_no": len(self.rows), "kind": "code" if tag in ("pre", "code") else "text", "content": text})

    def handle_starttag(self, tag, attrs):
        if tag in ("pre", "p", "h1", "h2", "h3", "h4", "li", "td", "title", "div") and not ("pre" in self.stack):
            self.flush(self.stack[-1] if self.stack else "")
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            if tag in ("pre", "p", "h1", "h2", "h3", "h4", "li", "td", "title", "div"):
                self.flush(tag)
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style"} & set(self.stack):
            self.text.append(data)


CELLS = "cell_no int, kind string, content string"


def html_cells(page: str) -> list[dict]:
    """Blocks of a page as code or text cells."""
    p = _Cells()
    p.feed(page)
    p.close()
    p.flush("")
    return p.rows


def notebook_cells(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, cell_no, cell_type, source): the cells of notebook JSON; null where it can't be read."""
    line = "struct<cells:array<struct<cell_type:string,source:{}>>>"
    as_list, as_text = F.from_json(F.col(json_col), line.format("array<string>")), F.from_json(F.col(json_col), line.format("string"))
    # a source is a list of lines or a text: the reading that gives no null for it counts
    x = df.select(id_col, F.posexplode(F.arrays_zip(as_list["cells"].alias("a"), as_text["cells"].alias("b"))).alias("cell_no", "c"))
    source = F.when(F.col("c.a.source").isNotNull(), F.array_join("c.a.source", "")).otherwise(F.col("c.b.source"))
    return x.select(id_col, "cell_no", F.coalesce("c.a.cell_type", "c.b.cell_type").alias("cell_type"), source.alias("source"))


def notebook_script(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, script): the code cells joined in order."""
    c = notebook_cells(df, id_col, json_col).filter("cell_type = 'code'")
    g = c.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("cell_no", "source"))).alias("s"))
    return g.select(id_col, F.array_join(F.transform("s", lambda x: x["source"]), "\n").alias("script"))


def context_variables(code: str, frames: list[str]) -> dict[str, str] | None:
    """Free names that are neither libraries nor frames, with the kind of their literal value; null if one has none.

    A snippet with a name of unknown kind can't stand alone.
    """
    t = _tree(code)
    if t is None:
        return None
    known = {}
    for s in t.body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
            v = constant_value(ast.unparse(s.value))
            known[s.targets[0].id] = None if v is None else type(ast.literal_eval(v)).__name__
    libraries = set(library_usages(code) or {})
    free = {n.id for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} - libraries - set(frames)
    free = {n for n in free if not hasattr(builtins, n)}
    if any(known.get(n) is None for n in free):
        return None
    return {n: known[n] for n in sorted(free)}


def lift_columns(code: str, columns: list[str]) -> tuple[str, dict[str, str]] | None:
    """Column names of a schema as variables col1.. in order of place, names assigned for the first time as new_col1..;
    a list of all columns as `columns`. The second part says what each stands for."""
    t = _tree(code)
    if t is None:
        return None
    names: dict[str, str] = {}
    have, n = set(columns), {"col": 0, "new_col": 0}
    new = {x.slice.value for s in ast.walk(t) if isinstance(s, ast.Assign) for x in s.targets if isinstance(x, ast.Subscript) and isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, str) and x.slice.value not in have}

    class Lift(ast.NodeTransformer):
        def visit(self, node):
            if isinstance(node, ast.List) and len(node.elts) == len(columns) > 1 and [getattr(e, "value", None) for e in node.elts] == columns:
                names["columns"] = repr(columns)
                return ast.Name(id="columns", ctx=ast.Load())
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and (node.value in have or node.value in new):
                key = repr(node.value)
                if key not in names.values():
                    kind = "col" if node.value in have else "new_col"
                    n[kind] += 1
                    names[f"{kind}{n[kind]}"] = key
                return ast.Name(id=next(k for k, v in names.items() if v == key), ctx=ast.Load())
            if isinstance(node, ast.JoinedStr):
                return node
            return self.generic_visit(node)

    return _text(Lift().visit(t)), names


def is_instantiation(pattern: str, code: str, params: list[str], text: str) -> bool:
    """Whether a code is the pattern with its parameters filled in, each of which the text mentions."""
    return unify(pattern, code, params) is not None and all(re.search(rf"(?<!\w){re.escape(p)}(?!\w)", text) for p in params)


def top_tokens(tokens: list[str], tops: list[list[str]], start: int, stop: int) -> list[list[str]]:
    """The alternatives of the tokens that cover the characters [start, stop) of the joined text."""
    at, out = 0, []
    for t, alternatives in zip(tokens, tops):
        if at < stop and at + len(t) > start:
            out.append(alternatives)
        at += len(t)
    return out
