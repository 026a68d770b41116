"""Source files that do not parse: errors per file, rates per owner and language.

Every file goes through the recursive-descent parsers; what they reject is checked exactly (Python's own parser, a
strict JSON reader) before it is reported, as they are stricter in a few exotic places and never more lenient.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstone.llm import jsonsyntax, pysyntax

SCHEMA = "tbl string, row_id long, owner string, language string, errors array<struct<line:int,cause:string>>, first_cause string, first_line int"
_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))


def python_errors(src: str) -> list[tuple[int, str]]:
    found = pysyntax.errors_of(src)
    if found:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(src)
                return []
            except (SyntaxError, ValueError):
                pass
            except (RecursionError, MemoryError):
                return [(1, "nested too deeply")]
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def json_errors(src: str) -> list[tuple[int, str]]:
    found = jsonsyntax.errors_of(src)
    if found:
        try:
            json.loads(src, parse_constant=_no_constant)
            return []
        except (ValueError, RecursionError):
            pass
    return found


def notebook_errors(src: str) -> list[tuple[int, str]]:
    """Errors of a notebook: of its JSON, of its shape or of its code cells (lines count within the cell)."""
    found = json_errors(src)
    if found:
        return found
    try:
        nb = json.loads(src)
    except (ValueError, RecursionError):
        return [(1, "nested too deeply")]
    if not isinstance(nb, dict) or not isinstance(nb.get("cells"), list):
        return [(1, "no list of cells")]
    for cell in nb["cells"]:
        if not isinstance(cell, dict) or cell.get("cell_type") != "code":
            continue
        source = cell.get("source")
        if isinstance(source, list):
            source = "".join(x for x in source if isinstance(x, str))
        if not isinstance(source, str) or source.lstrip().startswith("%%"):
            continue
        if "%" in source or "!" in source:
            source = "\n".join(x for x in source.split("\n") if not x.lstrip().startswith(("%", "!")))
        found += python_errors(source)
    return found


def language_of(path: str | None) -> str | None:
    """By the extension in any case; null for other files, which are not checked."""
    for ext, lang in ((".py", "python"), (".json", "json"), (".ipynb", "notebook")):
        if path and path.lower().endswith(ext):
            return lang
    return None


_CHECKS = {"python": python_errors, "json": json_errors, "notebook": notebook_errors}


def check_files(df: DataFrame, tbl: str, id_col: str, uid_col: str, text_col: str, path_col: str | None = None, all_rows: bool = True) -> DataFrame:
    """Errors of each file: SCHEMA; first_cause is null where the file parses.

    Without path_col all is Python. Null contents are no file (no row), nor are files of other extensions; an empty
    Python file parses, an empty JSON file does not. Re-delivered rows come out once each as delivered. Rows are
    handled one by one in one pass without a shuffle, whatever other columns there are. all_rows=False leaves the
    files that parse out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out: list[list] = [[], [], [], [], [], []]
            for i, uid, text, path in zip(*cols):
                lang = "python" if path_col is None else language_of(path)
                if text is None or lang is None:
                    continue
                errors = _CHECKS[lang](text)
                if errors or all_rows:
                    for o, v in zip(out, (i, uid.split("/", 1)[0] if uid is not None else None, lang, [{"line": a, "cause": c} for a, c in errors], errors[0][1] if errors else None, errors[0][0] if errors else None)):
                        o.append(v)
            n = len(out[0])
            yield pa.record_batch(
                [pa.array([tbl] * n, pa.string()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], _ERRORS), pa.array(out[4], pa.string()), pa.array(out[5], pa.int32())],
                names=["tbl", "row_id", "owner", "language", "errors", "first_cause", "first_line"],
            )

    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).alias("row_id"), F.col(uid_col).alias("uid"), F.col(text_col).alias("text"), path.alias("path")).mapInArrow(run, SCHEMA)


def once(checked: DataFrame) -> DataFrame:
    """One row per file: re-delivered files have equal content."""
    return checked.dropDuplicates(["tbl", "row_id"])


def rates(checked: DataFrame) -> DataFrame:
    """Files and share of broken files per table, owner and language; owner null where the file has none."""
    return (
        once(checked.select("tbl", "row_id", "owner", "language", "first_cause"))
        .groupBy("tbl", "owner", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("first_cause").alias("n_broken"))
        .withColumn("broken_rate", F.col("n_broken") / F.col("n_files"))
    )
