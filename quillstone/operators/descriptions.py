"""Dataflow around generated descriptions: prompts, candidates, verification in steps, transfer and training pairs.

The model itself is outside: it reads a table of prompts and returns completions(prompt_id, candidate, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.functions import code
from quillstone.operators import corpus


def prompts(tasks: DataFrame, examples: DataFrame, order: str, head: str = "", shots: int = 3) -> DataFrame:
    """(task_id, prompt): each task's code behind the first `shots` examples (code, text) of its kind in order."""
    w = Window.partitionBy("kind").orderBy(order)
    few = examples.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= shots)
    shown = few.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("__n", F.concat(F.lit("Code:\n"), "code", F.lit("\nDescription: "), "text").alias("s")))).alias("s"))
    blocks = F.coalesce(F.transform("s", lambda x: x["s"]), F.array().cast("array<string>"))
    parts = F.concat(F.array(F.lit(head)) if head else F.array().cast("array<string>"), blocks, F.array(F.concat(F.lit("Code:\n"), "code", F.lit("\nDescription:"))))
    return tasks.join(shown, "kind", "left").select("task_id", F.array_join(parts, "\n\n").alias("prompt"))


def candidates(completions: DataFrame) -> DataFrame:
    """(prompt_id, texts): the different trimmed texts of each prompt in order of candidate; blank ones drop out."""
    t = completions.withColumn("t", F.trim("text")).filter(F.col("t") != "").groupBy("prompt_id", "t").agg(F.min("candidate").alias("c"))
    return t.groupBy("prompt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("texts"))


def bullets(c: Column) -> Column:
    """struct(primary, auxiliary) of a text with lines that begin with `* `."""
    parts = F.transform(F.split(c, r"\n\* "), lambda x: F.trim(x))
    return F.struct(F.regexp_replace(parts[0], r"^\* ", "").alias("primary"), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "").alias("auxiliary"))


def least_level(checks: DataFrame, key: list[str], level: str, passed: str) -> DataFrame:
    """(key, level): the least level of assistance at which something passed; keys where nothing did drop out.

    The staged form, in which only failures of a level go on to the next, gives the same rows.
    """
    return checks.filter(F.col(passed)).groupBy(*key).agg(F.min(level).alias(level))


def strict_then_lenient(candidates_: DataFrame, key: str, strict: Column, lenient: Column) -> DataFrame:
    """Candidates that pass the strict test; of keys without any, those that pass the lenient one."""
    ok = candidates_.withColumn("mode", F.when(F.coalesce(strict, F.lit(False)), "strict").when(F.coalesce(lenient, F.lit(False)), "lenient")).filter("mode is not null")
    any_strict = F.max((F.col("mode") == "strict").cast("int")).over(Window.partitionBy(key)) == 1
    return ok.withColumn("__s", any_strict).filter((F.col("mode") == "strict") | ~F.col("__s")).drop("__s")


def outcomes(checked: DataFrame, key: str, text: str, good: Column) -> DataFrame:
    """(key, success, failed): the texts of a record parted by the test, in order."""
    g = F.coalesce(good, F.lit(False))
    return checked.groupBy(key).agg(F.sort_array(F.collect_list(F.when(g, F.col(text)))).alias("success"), F.sort_array(F.collect_list(F.when(~g, F.col(text)))).alias("failed"))


def diverse(descriptions: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One description per key and normalised text (case and white space don't count), the first by order."""
    norm = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return descriptions.withColumn("__n", F.row_number().over(Window.partitionBy(key, norm).orderBy(order))).filter("__n = 1").drop("__n")


def transfer(documented: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, description, is_derived): descriptions handed on to other items of the same template.

    documented: item_id, template, code, description. items: item_id, template, code. A template with placeholders is
    unified with both codes; what a placeholder stands for in the documented code is replaced in the description by
    what it stands for in the other. Items that do not unify get none. Of several documented items of a template the
    smallest id counts, so that no template multiplies its rows.
    """
    first = documented.groupBy("template").agg(F.min_by(F.struct("item_id", "code", "description"), "item_id").alias("d"))
    todo = items.join(documented.select("item_id"), "item_id", "left_anti").join(first, "template")

    def hand_on(template: str, a: str, b: str, text: str) -> str | None:
        import re

        params = sorted(set(re.findall(r"\b[A-Z]+(?:_LIST)?\d+\b", template)))
        x, y = code.unify(template, a, params), code.unify(template, b, params)
        if x is None or y is None:
            return None
        plain = lambda v: v.strip("'\"")
        return code.instantiate(text, {plain(x[p]): plain(y[p]) for p in params if re.fullmatch(r"\w+", plain(x[p]))})

    out = todo.select("item_id", code.udf(hand_on)("template", "d.code", "code", "d.description").alias("description"), F.lit(True).alias("is_derived"))
    return out.filter("description is not null")


def quote_variants(pairs: DataFrame, code_col: str, text_col: str) -> DataFrame:
    """Training pairs with the text as it is, with double and with no quotes; every text once (the smallest code)."""
    t = F.col(text_col)
    x = pairs.select(code_col, F.explode(F.array(t, F.replace(t, F.lit("'"), F.lit('"')), F.regexp_replace(t, "['\"`]", ""))).alias(text_col))
    return x.filter(F.col(text_col).isNotNull()).groupBy(text_col).agg(F.min(code_col).alias(code_col))


def embedding_pairs(df: DataFrame, group: str, item: str, span: int, per_item: int, seed: int = 0) -> DataFrame:
    """(a, b, score): positive pairs within a class (1.0) and negative ones across classes (0.0)."""
    pos = corpus.pairs_within(df, group, item, span).select("a", "b", F.lit(1.0).alias("score"))
    neg = corpus.negatives(df, group, item, per_item, seed).select(F.col(item).alias("a"), F.col("other").alias("b"), F.lit(0.0).alias("score"))
    return pos.unionByName(neg)


def solved(results: DataFrame, key: str, passed: str) -> DataFrame:
    """(key, solved): whether any attempt passed."""
    return results.groupBy(key).agg(F.coalesce(F.bool_or(passed), F.lit(False)).alias("solved"))


def top_token_prefix(a: Column, b: Column) -> Column:
    """How many leading tokens two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + (s["go"] & x).cast("int")).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])
