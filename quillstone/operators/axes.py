"""Selection by labels, levels of an index, and conversions of whole frames.

A frame's index is a list of plain columns (its levels), so an operation on labels is one on those columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType

from quillstone.operators.frame import pearson, position

# -- selection


def loc(df: DataFrame, key: str, labels: list | None = None, between: tuple | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows by label: those in `labels`, or a slice (both ends belong to it, null is open), and the columns asked for.

    A label that no row has raises KeyError, as a lookup does.
    """
    x = df
    if labels is not None:
        x = x.filter(F.col(key).isin(list(labels)))
        have = {r[0] for r in x.select(key).distinct().collect()}  # no more than the labels given
        gone = [v for v in labels if v not in have]
        if gone:
            raise KeyError(gone)
    if between is not None:
        low, high = between
        x = x if low is None else x.filter(F.col(key) >= F.lit(low))
        x = x if high is None else x.filter(F.col(key) <= F.lit(high))
    return x if columns is None else x.select(key, *columns)


def at(df: DataFrame, key: dict, column: str):
    """The one value at a label; KeyError without a row, ValueError with several."""
    x = df
    for k, v in key.items():
        x = x.filter(F.col(k).eqNullSafe(F.lit(v)))
    got = x.select(column).take(2)
    if not got:
        raise KeyError(key)
    if len(got) > 1:
        raise ValueError(f"{key} names more than one row")
    return got[0][0]


def iat(df: DataFrame, order: list[str], row: int, column: str):
    """The value at a 0-based position of an order (negative from the end)."""
    at_ = row if row >= 0 else df.count() + row
    got = position(df, order, "__p").filter(F.col("__p") == at_).select(column).take(1)
    if not got:
        raise IndexError(row)
    return got[0][0]


def xs(df: DataFrame, level: str, value, drop_level: bool = True) -> DataFrame:
    """Rows with one value in a level of the index, which is dropped unless kept."""
    x = df.filter(F.col(level).eqNullSafe(F.lit(value)))
    return x.drop(level) if drop_level else x


def get(df: DataFrame, columns: list[str], default=None) -> DataFrame:
    """The columns that the frame has, others filled with a default."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in columns])


def select_dtypes(df: DataFrame, include: str = "number", exclude: list[str] | None = None) -> DataFrame:
    """Columns by kind: number, or a Spark type name such as string or timestamp_ntz."""
    keep = [f.name for f in df.schema.fields if (isinstance(f.dataType, NumericType) if include == "number" else f.dataType.simpleString() == include)]
    return df.select(*[c for c in keep if c not in (exclude or [])])


def filter_columns(df: DataFrame, items: list[str] | None = None, like: str | None = None, regex: str | None = None) -> DataFrame:
    """Columns by name: listed, holding a text, or matching a pattern."""
    return df.select(*[c for c in df.columns if (items is None or c in items) and (like is None or like in c) and (regex is None or re.search(regex, c))])


def facts(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, size, is_empty, and has_nulls (an array of the columns with missing values)."""
    holes = F.array_compact(F.array(*[F.when(F.count(c) < F.count(F.lit(1)), F.lit(c)) for c in df.columns]))
    n, k = F.count(F.lit(1)), F.lit(len(df.columns)).cast("long")
    return df.agg(n.alias("n_rows"), k.alias("n_columns"), (n * k).alias("size"), (n == 0).alias("is_empty"), holes.alias("has_nulls"))


def squeeze(df: DataFrame):
    """The value of a frame of one row and column, or the frame as it is."""
    if len(df.columns) != 1:
        return df
    got = df.take(2)
    return got[0][0] if len(got) == 1 else df


# -- levels


def droplevel(df: DataFrame, levels: list[str]) -> DataFrame:
    return df.drop(*levels)


def reorder_levels(df: DataFrame, index: list[str], order: list[str]) -> DataFrame:
    """The index levels in another order, before the other columns; swaplevel is the exchange of two."""
    if sorted(index) != sorted(order):
        raise ValueError("the levels must stay the same")
    return df.select(*order, *[c for c in df.columns if c not in index])


def set_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def from_product(spark: SparkSession, levels: dict[str, list]) -> DataFrame:
    """All combinations of given labels; they grow with the product, without a join."""
    x = spark.range(1)
    for name, values in levels.items():
        x = x.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return x.drop("id")


def indexer(labels: DataFrame, index: DataFrame, key: str, order: str) -> DataFrame:
    """(key, place): the 0-based place of each label in an index in its order, -1 for none; repeated ones give all places."""
    return labels.select(key).join(position(index.select(key, order), [order], "place").select(key, "place"), key, "left").fillna(-1, ["place"])


def slice_bounds(index: DataFrame, key: str, low, high) -> DataFrame:
    """(start, stop): between which places of a sorted index the labels from low to high (both included) lie."""
    return index.agg(F.count_if(F.col(key) < F.lit(low)).alias("start"), F.count_if(F.col(key) <= F.lit(high)).alias("stop"))


def delete(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """Without the rows at these 0-based places of an order."""
    return position(df, order, "__p").filter(~F.col("__p").isin(places)).drop("__p")


def insert(df: DataFrame, order: list[str], place: int, row: dict) -> DataFrame:
    """With a row put in before a 0-based place, as column `place` of the result tells."""
    p = position(df, order, "place")
    p = p.withColumn("place", F.col("place") + (F.col("place") >= place).cast("int"))
    one = df.sparkSession.range(1).select(*[F.lit(row.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.lit(place).alias("place"))
    return p.unionByName(one)


def repeat(df: DataFrame, times: Column) -> DataFrame:
    """Every row so many times; none for less than one or null."""
    return df.withColumn("__t", times.cast("int")).filter("__t > 0").withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__t")


def first_valid(df: DataFrame, column: str, order: str) -> DataFrame:
    """(first_valid, last_valid): where a column's first and last present values are."""
    here = F.when(F.col(column).isNotNull(), F.col(order))
    return df.agg(F.min(here).alias("first_valid"), F.max(here).alias("last_valid"))


# -- values


def combine(a: DataFrame, b: DataFrame, key: list[str], f, fill=None) -> DataFrame:
    """f(column of a, column of b) for the columns that both have, over the rows of either."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    x = a.select(*key, *[F.col(c).alias(f"{c}_x") for c in shared]).join(b.select(*key, *[F.col(c).alias(f"{c}_y") for c in shared]), key, "full")
    side = lambda c: F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill))
    return x.select(*key, *[f(side(f"{c}_x"), side(f"{c}_y")).alias(c) for c in shared])


def corrwith(df: DataFrame, columns: list[str], other: str) -> DataFrame:
    """(column_name, corr) of each column with another, in one pass."""
    got = df.agg(*[pearson(c, other).alias(c) for c in columns])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("corr")) for c in columns])).alias("x")).select("x.*")


def convert_types(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest of bigint, double, boolean and timestamp_ntz that all their present values are; one pass to tell."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    kinds = ("bigint", "double", "boolean", "timestamp_ntz")
    if not texts:
        return df
    fits = [F.coalesce(F.bool_and(F.expr(f"try_cast(`{c}` as {k}) is not null") | F.col(c).isNull()) & (F.count(c) > 0), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(texts) for k in kinds]
    row = df.agg(*fits).first()
    best = {c: next((k for k in kinds if row[f"{i}_{k}"]), None) for i, c in enumerate(texts)}
    return df.select(*[F.col(c).cast(best[c]).alias(c) if best.get(c) else F.col(c) for c in df.columns])


def evaluate(df: DataFrame, text: str, values: dict | None = None) -> DataFrame:
    """Lines `name = expression` as new or replaced columns, each seeing those before; @name stands for a given value."""
    x = df
    for line in filter(None, (s.strip() for s in text.splitlines())):
        m = re.fullmatch(r"(\w+)\s*=(?!=)\s*(.+)", line)
        if not m:
            raise ValueError(f"no assignment: {line}")
        e = re.sub(r"@(\w+)", lambda k: repr((values or {})[k.group(1)]), m.group(2))
        e = re.sub(r"([\w.]+|\([^()]*\))\s*\*\*\s*([\w.]+|\([^()]*\))", r"power(\1, \2)", e)
        x = x.withColumn(m.group(1), F.expr(e.replace("==", "=")))
    return x


def recode(df: DataFrame, column: str) -> DataFrame:
    """Rows with the 0-based place of their value among the sorted distinct ones (`place`), -1 for a missing one."""
    codes = position(df.filter(F.col(column).isNotNull()).select(column).distinct(), [column], "place")
    return df.join(codes, column, "left").fillna(-1, ["place"])


def stack_levels(df: DataFrame, index: list[str], sep: str = "_") -> DataFrame:
    """Columns <a><sep><b> as rows (index, level_0, level_1, value): both levels at once; missing values drop out."""
    x = df.unpivot(index, [c for c in df.columns if c not in index], "__c", "value").filter(F.col("value").isNotNull())
    return x.select(*index, F.substring_index("__c", sep, 1).alias("level_0"), F.expr(f"substring(__c, instr(__c, '{sep}') + {len(sep)})").alias("level_1"), "value")


def unstack(df: DataFrame, index: list[str], level: str, values: list, value: str) -> DataFrame:
    """The labels of a level as columns; combinations without a row are null."""
    return df.groupBy(*index).pivot(level, values).agg(F.first(value))


def shift_times(df: DataFrame, at_: str, interval: str, times: int = 1) -> DataFrame:
    """The time axis moved, the values left where they are."""
    return df.withColumn(at_, F.col(at_) + F.expr(f"INTERVAL {interval}") * F.lit(times))


def group_apply(df: DataFrame, by: list[str], f, schema: str) -> DataFrame:
    """f of each group as a pandas frame: for what no aggregate expresses; a group must fit into a task's memory."""
    return df.groupBy(*by).applyInPandas(f, schema)


def group_filter(df: DataFrame, by: list[str], value: Column, keep) -> DataFrame:
    """Rows of the groups for which `keep` of an aggregate over the group holds."""
    return df.withColumn("__k", value.over(Window.partitionBy(*by))).filter(keep(F.col("__k"))).drop("__k")
