"""Mining of snippets from code and notebooks: candidates by a table of method kinds, and derived notebook columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillstone.functions import code

#: What methods of frames give: a frame, a series, a grouping or a scalar.
RESULTS = {
    **{m: "DF" for m in "head tail drop dropna fillna merge join rename sort_values sort_index reset_index set_index assign query copy astype replace drop_duplicates sample nlargest nsmallest describe pivot_table pivot melt explode stack unstack transpose round clip where mask".split()},
    **{m: "SERIES" for m in "value_counts nunique isnull isna notnull notna sum mean median min max std var count any all idxmax idxmin cumsum shift diff rank unique".split()},
    **{m: "GROUPBY" for m in ("groupby", "resample", "rolling", "expanding")},
}
SNIPPETS = "snippet_no int, kind string, expr_type string, code string, template string, line int"
#: Snippets with more string constants than this are data, not code.
MAX_STRINGS = 15


def result_kind(node: ast.expr, frames: set[str]) -> str | None:
    """DF, SERIES or GROUPBY of an expression over known frames; null if it can't be told."""
    if isinstance(node, ast.Name):
        return "DF" if node.id in frames else None
    if isinstance(node, ast.Subscript):
        base = result_kind(node.value, frames)
        if base == "DF":
            return "SERIES" if isinstance(node.slice, ast.Constant) else "DF"
        return base
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        base = result_kind(node.func.value, frames)
        if base:
            kind = RESULTS.get(node.func.attr)
            return "DF" if kind == "SERIES" and base == "GROUPBY" else kind
        if isinstance(node.func.value, ast.Name) and node.func.value.id in ("pd", "pandas"):
            return "DF" if node.func.attr in ("read_csv", "DataFrame", "merge", "concat", "read_parquet", "get_dummies", "read_json") else "SERIES" if node.func.attr in ("Series", "to_datetime", "cut") else None
    if isinstance(node, ast.Attribute) and node.attr in ("str", "dt", "loc", "iloc", "T"):
        return result_kind(node.value, frames)
    if isinstance(node, (ast.BinOp, ast.Compare)):
        return result_kind(node.left, frames)
    return None


def snippets(source: str) -> list[dict]:
    """Outermost expressions over frames in order of place; frames are names bound to a frame before."""
    tree = code._tree(source)
    if tree is None:
        return []
    frames = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and (n.id == "df" or n.id.endswith("_df"))}
    found: list[tuple[ast.expr, str, str]] = []

    def visit(n: ast.AST) -> None:
        if isinstance(n, ast.Assign):
            kind = result_kind(n.value, frames)
            if kind == "DF":
                frames.update(t.id for t in n.targets if isinstance(t, ast.Name))
        if isinstance(n, ast.expr) and not isinstance(n, (ast.Name, ast.Constant)):
            kind = result_kind(n, frames)
            if kind and isinstance(getattr(n, "ctx", ast.Load()), ast.Load):
                found.append((n, {"DF": "DF_EXPR", "SERIES": "SERIES_EXPR", "GROUPBY": "DF_SERIES_GROUPBY_ATTR_ACCESS"}[kind], kind))
                return
            if isinstance(n, ast.Call):
                over = any(result_kind(a, frames) for a in [*n.args, *(k.value for k in n.keywords)])
                if over:
                    found.append((n, "API_USAGE" if isinstance(n.func, ast.Attribute) else "CALLED_W_PD_ARGS", "UNKNOWN"))
                    return
            if isinstance(n, ast.Subscript) and result_kind(n.slice, frames):
                found.append((n, "SUBSCRIPT_W_PD_ARGS", "UNKNOWN"))
                return
        for c in ast.iter_child_nodes(n):
            visit(c)

    visit(tree)
    out: dict[str, dict] = {}
    for n, kind, t in found:
        if sum(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in ast.walk(n)) > MAX_STRINGS:
            continue
        text = ast.unparse(n)
        shape = code.template(text, sorted(frames))
        out[text] = {"snippet_no": 0, "kind": kind, "expr_type": t, "code": text, "template": shape[0] if shape else None, "line": n.lineno}
    return [{**r, "snippet_no": i} for i, r in enumerate(out.values())]


def mine(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """(id_col, SNIPPETS) of every code; those that do not parse give none."""
    return code.exploded(df, id_col, code_col, snippets, SNIPPETS)


def is_parseable(c: Column) -> Column:
    """Whether Python code parses; null stays null."""
    return code.udf(lambda s: code._tree(s) is not None, "boolean")(c)


def notebook_facts(df: DataFrame, json_col: str) -> DataFrame:
    """Rows with columns from notebook JSON: kernel, language, n_cells, n_code_cells, digest."""
    j = F.from_json(F.col(json_col), "struct<metadata:struct<kernelspec:struct<name:string,display_name:string>,language_info:struct<name:string>>,cells:array<struct<cell_type:string>>>")
    n = F.size(F.coalesce(j["cells"], F.array().cast("array<struct<cell_type:string>>")))
    return df.select("*", j["metadata"]["kernelspec"]["name"].alias("kernel"), j["metadata"]["language_info"]["name"].alias("language"), n.alias("n_cells"), F.size(F.filter(F.coalesce(j["cells"], F.array().cast("array<struct<cell_type:string>>")), lambda c: c["cell_type"] == "code")).alias("n_code_cells"), F.sha2(F.col(json_col), 256).alias("digest"))


def source_class(url: Column) -> Column:
    """Kind of a data source by the shape of its address."""
    return F.when(F.contains(url, F.lit("/c/")) | F.contains(url, F.lit("/competitions/")), "COMPETITION").when(F.contains(url, F.lit("/datasets/")), "DATASET").when(F.contains(url, F.lit("/code/")) | F.contains(url, F.lit("/kernels/")), "KERNEL_OUTPUT").when(url.isNotNull(), "UNKNOWN")


class Campaign:
    """A source of keys and tasks with what is to be done to each task; a run handles what is not done yet."""

    def __init__(self, keys: Callable[[SparkSession], DataFrame], tasks: Callable[[SparkSession, DataFrame], DataFrame], work: Callable[[DataFrame], DataFrame]):
        self.keys, self.tasks, self.work = keys, tasks, work

    def run(self, spark: SparkSession, store) -> int:
        """Handles the keys that the store has not, and returns how many there were."""
        todo = self.keys(spark).select(store.key).distinct().join(store.read().select(store.key), store.key, "left_anti")
        n = todo.count()
        if n:
            store.insert_missing(self.work(self.tasks(spark, todo)))
        return n


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], key: str) -> DataFrame:
    """Steps one after the other, each adding columns to the same records; one that loses a column or changes keys' names raises."""
    for f in steps:
        before = set(df.columns)
        df = f(df)
        if not before <= set(df.columns):
            raise ValueError(f"{getattr(f, '__name__', f)} drops {sorted(before - set(df.columns))}")
        if key not in df.columns:
            raise ValueError(f"no column {key}")
    return df


def associated_competition(sources: Column) -> Column:
    """The one competition among an array of addresses, null if there is none or are several."""
    c = F.filter(sources, lambda x: source_class(x) == "COMPETITION")
    return F.when(F.size(c) == 1, c[0])


def code_cells(cells: Column) -> Column:
    """The code cells of an array of struct(cell_type, source), blank ones left out."""
    return F.filter(cells, lambda c: (c["cell_type"] == "code") & (F.trim(F.coalesce(c["source"], F.lit(""))) != ""))


#: Functions by name, for campaigns that are told by text what to do.
REGISTRY: dict[str, Callable] = {}


def registered(name: str) -> Callable:
    """A decorator that enters a function in REGISTRY; a name that is taken raises."""

    def enter(f: Callable) -> Callable:
        if name in REGISTRY:
            raise KeyError(name)
        REGISTRY[name] = f
        return f

    return enter
