"""Operations on labelled axes: alignment, reindexing, categories, intervals, ranges and lookups.

A frame's index is a set of plain columns; categories are a dimension table (label, code); intervals are a pair of
columns with a rule of closedness.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillstone.operators import joins
from quillstone.operators.frame import global_lag, pearson, position
from quillstone.session import materialize

#: Most groups that are sent to every task, and most blocks of a group (their pairs are counted in one task).
MAX_GROUPS, BLOCKS = 100_000, 1_000

# -- alignment and filling from another frame


def reindex(df: DataFrame, labels: DataFrame, key: list[str], fill: dict | None = None) -> DataFrame:
    """The rows of `labels` (key) with the columns of df; labels that df has not get nulls or `fill`."""
    out = labels.select(*key).join(df, key, "left")
    return out.fillna(fill) if fill else out


def align(a: DataFrame, b: DataFrame, key: list[str], how: str = "outer") -> DataFrame:
    """Both frames side by side on their keys; clashing columns get _x and _y."""
    return joins.merge(a, b, key, how)


def combine_first(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Values of a, where missing those of b; rows of either."""
    j = joins.merge(a, b, key, "outer")
    cols = [*a.columns, *[c for c in b.columns if c not in a.columns]]
    pick = lambda c: F.coalesce(f"{c}_x", f"{c}_y").alias(c) if c in a.columns and c in b.columns else F.col(c)
    return j.select(*key, *[pick(c) for c in cols if c not in key])


def update(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Values of a overwritten by the present values of b; only rows of a. Keys of b must be unique."""
    j = joins.merge(a, b, key, "left", validate="many_to_one")
    return j.select(*[F.col(c) if c in key or c not in b.columns else F.coalesce(f"{c}_y", f"{c}_x").alias(c) for c in a.columns])


def lookup(df: DataFrame, index: str, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(index, column_name, value) for each wanted (index, column_name) pair."""
    return wanted.join(df.unpivot([index], columns, "column_name", "value"), [index, "column_name"], "left")


def truncate(df: DataFrame, key: str, before=None, after=None) -> DataFrame:
    """Rows with before <= key <= after."""
    out = df if before is None else df.filter(F.col(key) >= before)
    return out if after is None else out.filter(F.col(key) <= after)


def first_offset(df: DataFrame, at: str, interval: str, last: bool = False) -> DataFrame:
    """Rows within an interval from the first (up to the last) time."""
    edge = df.agg(F.max(at) if last else F.min(at)).first()[0]
    if edge is None:
        return df.limit(0)
    bound = F.lit(edge) - F.expr(f"INTERVAL {interval}") if last else F.lit(edge) + F.expr(f"INTERVAL {interval}")
    return df.filter(F.col(at) > bound if last else F.col(at) < bound)


def searchsorted(values: DataFrame, sorted_: DataFrame, column: str, id_col: str, side: str = "left") -> DataFrame:
    """(id_col, place): at which 0-based place each value would go into the other frame's sorted column.

    One shuffle: both are put under each other and the sorted ones counted along the way, by range partitions.
    """
    rank = 0 if side == "left" else 2
    both = values.select(F.col(id_col).alias("__id"), F.col(column).alias("__v"), F.lit(rank).alias("__s")).unionByName(sorted_.select(F.lit(None).alias("__id"), F.col(column).alias("__v"), F.lit(1).alias("__s")).filter(F.col("__v").isNotNull()))
    p = position(both.filter(F.col("__v").isNotNull()), ["__v", "__s", "__id"], "__p")
    mine = position(p.filter(F.col("__s") != 1), ["__p"], "__q")
    return mine.select(F.col("__id").alias(id_col), (F.col("__p") - F.col("__q")).alias("place"))


# -- order predicates


def order_facts(df: DataFrame, column: str, order: str) -> DataFrame:
    """is_unique, is_increasing, is_decreasing of a column in an order; of no rows all are true."""
    x = global_lag(df.select(F.col(column).alias("v"), F.col(order).alias("o")), "v", ["o"], "p")
    return x.agg((F.count("v") == F.count_distinct("v")).alias("is_unique"), F.coalesce(F.bool_and(F.col("v") >= F.col("p")), F.lit(True)).alias("is_increasing"), F.coalesce(F.bool_and(F.col("v") <= F.col("p")), F.lit(True)).alias("is_decreasing"))


def autocorr(df: DataFrame, column: str, order: str, by: list[str], lag: int = 1) -> DataFrame:
    """(by, autocorr): correlation with the value `lag` rows before."""
    x = df.withColumn("__p", F.lag(column, lag).over(Window.partitionBy(*by).orderBy(order)))
    return x.groupBy(*by).agg(pearson(column, "__p").alias("autocorr"))


def inversions(q: np.ndarray) -> int:
    """How many pairs of different numbers are in falling order, in n log n: bit by bit, ones before zeros of one prefix."""
    if len(q) < 2:
        return 0
    x = np.empty(len(q), np.int64)
    x[np.argsort(q)] = np.arange(len(q))
    total = 0
    for bit in reversed(range(int(len(q) - 1).bit_length())):
        one = x >> bit & 1
        ones = np.cumsum(one)
        prefix = x >> (bit + 1)  # rows of a prefix lie side by side
        start = np.searchsorted(prefix, prefix)
        before = np.where(start > 0, ones[start - 1], 0)
        total += int(((ones - before) * (1 - one)).sum())
        x = x[np.argsort(x >> bit, kind="stable")]
    return total


def kendall(df: DataFrame, a: str, b: str, by: list[str], most: int | None = None, block: int = 100_000) -> DataFrame:
    """(by, kendall): tau-b per group, exact; null where a column doesn't vary. Rows with a missing value take no part.

    Groups of up to `block` rows are counted in one task each, in n log n; larger ones over blocks of rows. With `most`,
    groups of more rows raise.
    """
    kinds = dict(df.dtypes)
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("float", "double") else F.col(c).isNull()
    x = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.col(a).alias("a"), F.col(b).alias("b"), (~(missing(a) | missing(b))).alias("ok")).filter("ok").drop("ok")
    g = [f"g{i}" for i in range(len(by))]
    names = [F.col(k).alias(c) for k, c in zip(g, by)]
    head = "".join(f"{k} {kinds[c]}, " for k, c in zip(g, by))
    hot = x.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (block if most is None else min(block, most)))
    hot = materialize(hot, "kendall")
    if most is not None and (worst := hot.agg(F.max("n")).first()[0] or 0) > most:
        raise ValueError(f"a group of {worst} rows; the bound is {most}")

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1].astype(np.int64) for c in ("a", "b"))
        n, both = len(v), np.unique(v * (int(w.max()) + 1) + w, return_counts=True)[1]
        tied = lambda t: int((t * (t - 1)).sum())
        pairs, ta, tb = n * (n - 1), tied(np.bincount(v)), tied(np.bincount(w))
        o = np.lexsort((w, v))
        q = np.empty(n, np.int64)
        q[np.argsort(w[o], kind="stable")] = np.arange(n)
        surplus = pairs - ta - tb + tied(both) - 4 * inversions(q)
        norm = np.sqrt(float(pairs - ta) * float(pairs - tb))
        return pdf[g].head(1).assign(kendall=float(surplus) / norm if norm else None)

    if hot.isEmpty():
        return x.groupBy(*g).applyInPandas(tau, head + "kendall double").select(*names, "kendall")
    gid = materialize(position(hot, g, "gid").select("gid", "n", *[F.col(k).alias(f"h{k}") for k in g]), "kendall")
    same = F.lit(True)
    for k in g:
        same = same & F.col(k).eqNullSafe(F.col(f"h{k}"))
    few = F.broadcast(gid) if gid.count() <= MAX_GROUPS else gid
    cold = x.join(few, same, "left_anti").groupBy(*g).applyInPandas(tau, head + "kendall double")
    large = _kendall_blocks(x.join(few, same).select("gid", "n", "a", "b"), block)
    return cold.unionByName(large.join(gid, "gid").select(*[F.col(f"h{k}").alias(k) for k in g], "kendall")).select(*names, "kendall")


def _kendall_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(gid, kendall) of rows (gid, n: rows of the group, a, b), no task holding more than about a block of them.

    p is the place in order of a and b, q the place in order of b and p: then the discordant pairs are those in falling
    order of q along p, ties being in rising order. Both are cut into blocks. Pairs of one p block are counted in it,
    pairs of one q block and two p blocks in that q block, and all others by the number of rows in each pair of blocks.
    """
    size = F.greatest(F.lit(block), F.ceil(F.col("n") / BLOCKS)).cast("long")
    p = materialize(position(rows, ["gid", "a", "b"], "p"), "kendall")
    q = materialize(position(p, ["gid", "b", "p"], "q"), "kendall")
    first = q.groupBy("gid").agg(F.min("p").alias("s"))  # groups lie at the same places in both orders
    q = materialize(q.join(F.broadcast(first) if first.count() <= MAX_GROUPS else first, "gid").select("gid", "p", "q", F.expr("p - s").alias("x"), F.expr("q - s").alias("y"), size.alias("size")).select("gid", "p", "q", F.expr("x div size").alias("pb"), F.expr("y div size").alias("qb")), "kendall")

    def inside(order: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            y = pdf.sort_values(order)["q"].to_numpy()
            return pdf[["gid"]].head(1).assign(d=inversions(y))

        return run

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf.pb.max()) + 1, int(pdf.qb.max()) + 1), np.int64)
        m[pdf.pb.to_numpy(), pdf.qb.to_numpy()] = pdf.c.to_numpy()
        later = m[:, ::-1].cumsum(axis=1)[:, ::-1] - m  # rows of the same p block in later q blocks
        before = later.cumsum(axis=0) - later
        return pdf[["gid"]].head(1).assign(d=int((m * before).sum()))

    d = q.groupBy("gid", "pb").applyInPandas(inside(["p"]), "gid long, d long")
    d = d.unionByName(q.groupBy("gid", "qb").applyInPandas(inside(["pb", "q"]), "gid long, d long"))
    d = d.unionByName(q.groupBy("gid", "pb", "qb").agg(F.count(F.lit(1)).alias("c")).groupBy("gid").applyInPandas(across, "gid long, d long"))
    d = d.groupBy("gid").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))
    out = d.join(rows.groupBy("gid").agg(F.first("n").alias("n")), "gid")
    for name, cols in (("ta", ["a"]), ("tb", ["b"]), ("tab", ["a", "b"])):
        n = F.col("count").cast("decimal(19,0)")
        out = out.join(p.groupBy("gid", *cols).count().groupBy("gid").agg(F.sum((n * (n - 1)).cast("decimal(38,0)")).alias(name)), "gid")
    n = F.col("n").cast("decimal(19,0)")
    pairs = (n * (n - 1)).cast("decimal(38,0)")
    surplus = (pairs - F.col("ta") - F.col("tb") + F.col("tab") - 4 * F.col("d")).cast("double")
    norm = F.sqrt((pairs - F.col("ta")).cast("double") * (pairs - F.col("tb")).cast("double"))
    return out.select("gid", F.try_divide(surplus, norm).alias("kendall"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices in coordinate form (i, j, v): joined on the inner index, summed."""
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return x.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


# -- groups


def nth(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row of each group (0-based, negative from the end); groups without one drop out."""
    o = [F.col(c).asc() if n >= 0 else F.col(c).desc() for c in order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*o))).filter(F.col("__n") == (n + 1 if n >= 0 else -n)).drop("__n")


def pct_change(df: DataFrame, column: str, order: str, by: list[str], periods: int = 1) -> DataFrame:
    """Relative change to `periods` rows before, missing values filled forward before."""
    w = Window.partitionBy(*by).orderBy(order)
    filled = df.withColumn("__f", F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("pct_change", F.try_divide(F.col("__f"), F.lag("__f", periods).over(w)) - 1).drop("__f")


# -- categories


def categories(df: DataFrame, column: str, order: list | None = None) -> DataFrame:
    """(label, code): the dimension table of a column, in the given order or sorted."""
    if order is not None:
        return df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], f"label {dict(df.dtypes)[column]}, code long")
    return position(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct(), ["label"], "code").withColumn("code", F.col("code").cast("long"))


def encode(df: DataFrame, column: str, dim: DataFrame, name: str = "code") -> DataFrame:
    """Rows with the code of their label, -1 for none."""
    return df.join(dim.select(F.col("label").alias(column), F.col("code").alias(name)), column, "left").fillna(-1, [name])


def category_counts(df: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """(label, n) of every category, unobserved ones with 0."""
    n = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return dim.select("label").join(n, "label", "left").fillna(0, ["n"])


def rename_categories(dim: DataFrame, names: dict) -> DataFrame:
    """The dimension table with new labels; codes stay."""
    return dim.withColumn("label", F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("label")], F.col("label")))


def set_categories(dim: DataFrame, labels: list[str]) -> DataFrame:
    """(label, code) of the given labels in their order: reorders, adds and removes; values without one get code -1."""
    return dim.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, code long")


def remove_unused(dim: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """The categories that occur, numbered anew in their order."""
    used = dim.join(df.select(F.col(column).alias("label")).distinct(), "label", "left_semi")
    return position(used, ["code"], "__c").select("label", F.col("__c").cast("long").alias("code"))


def category_bounds(df: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """(least, greatest): first and last category in their order among those that occur."""
    x = df.join(dim.select(F.col("label").alias(column), "code"), column)
    return x.agg(F.min_by(column, "code").alias("least"), F.max_by(column, "code").alias("greatest"))


# -- intervals


def in_interval(point: Column, left: Column, right: Column, closed: str = "right") -> Column:
    """Whether a point lies in an interval; closed: left, right, both or neither."""
    low = point >= left if closed in ("left", "both") else point > left
    high = point <= right if closed in ("right", "both") else point < right
    return low & high


def intervals_overlap(a: tuple[Column, Column], b: tuple[Column, Column], closed: str = "right") -> Column:
    """Whether two intervals of one closedness share a point."""
    if closed == "both":
        return (a[0] <= b[1]) & (b[0] <= a[1])
    return (a[0] < b[1]) & (b[0] < a[1])


def interval_facts(left: Column, right: Column, closed: str = "right") -> dict[str, Column]:
    return {"mid": (left + right) / 2, "length": right - left, "is_empty": (left == right) & F.lit(closed != "both")}


# -- ranges


def date_range(spark: SparkSession, start: str, end: str, every: str = "1 DAY") -> DataFrame:
    """(ts): regular times from start to end, both included."""
    s = lambda x: F.lit(x).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(s(start), s(end), F.expr(f"INTERVAL {every}"))).alias("ts"))


def business_date_range(spark: SparkSession, start: str, end: str, holidays: list[str] | None = None) -> DataFrame:
    """(ts): Mondays to Fridays that are no holidays."""
    d = date_range(spark, start, end)
    return d.filter((F.weekday("ts") < 5) & ~F.date_format("ts", "yyyy-MM-dd").isin(holidays or [""]))


def timedelta_range(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """(seconds): regular durations from start to end, both included."""
    return spark.range(int((end - start) // step) + 1).select((F.lit(float(start)) + F.col("id") * step).alias("seconds"))


def period_range(spark: SparkSession, start: str, end: str, unit: str) -> DataFrame:
    """(period, starts, ends): years, quarters, months or days from one that holds start to one that holds end."""
    from quillstone.functions import dates

    step = {"year": "1 YEAR", "quarter": "3 MONTH", "month": "1 MONTH", "day": "1 DAY"}[unit]
    first, last = F.date_trunc(unit, F.lit(start).cast("timestamp_ntz")).cast("date"), F.lit(end).cast("date")
    x = spark.range(1).select(F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step}"))).alias("starts"))
    return x.select(dates.period(F.col("starts"), unit).alias("period"), "starts", F.date_sub((F.col("starts") + F.expr(f"INTERVAL {step}")).cast("date"), 1).alias("ends"))


def interval_range(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """(left, right) of adjoining intervals."""
    n = int(round((end - start) / step))
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias("left"), (F.lit(start) + (F.col("id") + 1) * step).alias("right"))


def infer_frequency(df: DataFrame, at: str) -> int | None:
    """Seconds between rows if they are the same everywhere, else None."""
    d = F.unix_micros(F.col(at).cast("timestamp"))
    x = global_lag(df.select(d.alias("t")), "t", ["t"], "p").select((F.col("t") - F.col("p")).alias("d")).filter("d is not null")
    r = x.agg(F.min("d"), F.max("d")).first()
    return r[0] // 1_000_000 if r[0] is not None and r[0] == r[1] else None


def lreshape(df: DataFrame, groups: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Several groups of columns at once as rows: keep, one column per group; rows with a missing value drop out."""
    n = len(next(iter(groups.values())))
    rows = F.array(*[F.struct(*[F.col(cols[i]).alias(name) for name, cols in groups.items()]) for i in range(n)])
    return df.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*").dropna(subset=list(groups))


def query(df: DataFrame, text: str, values: dict | None = None) -> DataFrame:
    """Rows for which a pandas-style condition holds: ==, and, or, not, in [..], @name for a given value."""
    import re

    def value(v) -> str:
        if isinstance(v, (list, tuple, set)):
            return "(" + ", ".join(value(x) for x in v) + ")"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", text)
    for i in range(0, len(parts), 2):
        p = re.sub(r"@(\w+)", lambda m: value((values or {})[m.group(1)]), parts[i])
        parts[i] = re.sub(r"\]", ")", re.sub(r"\[", "(", p.replace("==", "="))).replace("&", " and ").replace("|", " or ")
    return df.filter(F.coalesce(F.expr("".join(parts)), F.lit(False)))
