"""Data-frame operations with pandas' rules on Spark: selection, missing values, ranks, windows, reshaping, resampling.

Frames have no hidden order: whatever depends on row order takes an explicit order column. Null and NaN are one kind of
missing (sources.tables.nan_to_null). Nulls sort last in either direction; null group keys are dropped; sums of nothing
are 0; comparisons with a missing value are false (unequal: true).
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.session import materialize

# -- arithmetic and comparison


def floordiv(a: Column, b: Column) -> Column:
    """Division rounded down; null where b is 0."""
    return F.floor(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null where b is 0."""
    return a - b * F.floor(F.try_divide(a, b))


def compare(a: Column, op: str, b: Column) -> Column:
    """lt, le, gt, ge, eq, ne with missing values: false, for ne true."""
    c = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}[op]
    return F.coalesce(c, F.lit(op == "ne"))


def clip(c: Column, low=None, high=None) -> Column:
    """`c` kept within bounds; missing stays missing."""
    if low is not None:
        c = F.when(c < low, F.lit(low)).otherwise(c)
    return c if high is None else F.when(c > high, F.lit(high)).otherwise(c)


def where(c: Column, cond: Column, other=None) -> Column:
    """`c` where cond holds, else other; an unknown condition does not hold."""
    return F.when(cond, c).otherwise(F.lit(other) if not isinstance(other, Column) else other)


def map_values(c: Column, mapping: dict) -> Column:
    """Values replaced by the mapping; others become null."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


# -- selection


def take(df: DataFrame, order: list[str], positions: list[int]) -> DataFrame:
    """Rows at 0-based positions of an order (negative ones from the end), with `position`."""
    n = df.count() if any(p < 0 for p in positions) else 0
    at = sorted({p if p >= 0 else n + p for p in positions})
    w = Window.orderBy(*order)
    # the prefix up to the last position is all that is numbered
    few = df.orderBy(*order).limit(at[-1] + 1) if at else df.limit(0)
    return few.withColumn("position", F.row_number().over(w) - 1).filter(F.col("position").isin(at))


def ranged(df: DataFrame, order: list[str], name: str = "__part") -> DataFrame:
    """Rows in ranges of an order, written once, with the number of their range: later ranges hold later rows."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id()), "rng")


def position(df: DataFrame, order: list[str], name: str = "position", by: list[str] | None = None) -> DataFrame:
    """0-based position in an order. Without `by` it is global: rows are ranged, counted per range and offset."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    r = ranged(df, order)
    sizes = r.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*order)
    return r.withColumn(name, F.row_number().over(w) - 1).join(F.broadcast(offset), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def global_lag(df: DataFrame, column: str, order: list[str], name: str) -> DataFrame:
    """The value of the row before in an order over the whole frame: within ranges, and across their borders by a table of one row per range."""
    r = ranged(df, order)
    w = Window.partitionBy("__part").orderBy(*order)
    ends = r.groupBy("__part").agg(F.max_by(F.struct(column), F.struct(*order)).alias("e"))
    ends = ends.select("__part", F.lag("e").over(Window.orderBy("__part")).alias("__e"))
    x = r.withColumn(name, F.lag(column).over(w)).withColumn("__n", F.row_number().over(w)).join(F.broadcast(ends), "__part")
    return x.withColumn(name, F.when(F.col("__n") == 1, F.col("__e")[column]).otherwise(F.col(name))).drop("__part", "__n", "__e")


def global_ffill(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Missing values taken from the last present one before in an order over the whole frame, as global_lag goes about it."""
    r = ranged(df, order)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*order)
    ends = r.groupBy("__part").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), key)).alias(f"__e{i}") for i, c in enumerate(columns)])
    ends = ends.select("__part", *[F.last(f"__e{i}", ignorenulls=True).over(before).alias(f"__b{i}") for i in range(len(columns))])
    at = {c: i for i, c in enumerate(columns)}
    x = r.join(F.broadcast(ends), "__part")
    return x.select(*[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__b{at[c]}")).alias(c) if c in at else F.col(c) for c in df.columns])


def nlargest(df: DataFrame, n: int, column: str, tie: str, keep: str = "first", smallest: bool = False) -> DataFrame:
    """The n largest (smallest) rows; keep: first or last of equal ones by `tie`, or all of them."""
    key = F.col(column).asc() if smallest else F.col(column).desc()
    df = df.filter(F.col(column).isNotNull())
    if keep != "all":
        return df.orderBy(key, F.col(tie).asc() if keep == "first" else F.col(tie).desc()).limit(n)
    edge = df.orderBy(key).limit(n).agg(F.max(column) if smallest else F.min(column)).first()[0]
    return df.filter(F.col(column) <= edge if smallest else F.col(column) >= edge) if edge is not None else df.limit(0)


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str], keep: str | bool = "first") -> DataFrame:
    """One row per subset by order: the first, the last, or (False) only rows without a double."""
    w = Window.partitionBy(*subset)
    if keep is False:
        return df.withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n = 1").drop("__n")
    best = (F.min_by if keep == "first" else F.max_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(subset)]).agg(best.alias("__r")).select("__r.*")


def duplicated(df: DataFrame, subset: list[str], order: list[str], keep: str | bool = "first") -> DataFrame:
    """All rows with the flag `is_duplicate`."""
    w = Window.partitionBy(*subset)
    if keep is False:
        return df.withColumn("is_duplicate", F.count(F.lit(1)).over(w) > 1)
    o = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("is_duplicate", F.row_number().over(w.orderBy(*o)) > 1)


# -- missing values


def ffill(df: DataFrame, columns: list[str], order: list[str], by: list[str], limit: int | None = None, backward: bool = False) -> DataFrame:
    """Missing values taken from the last present one before (behind, if backward), at most `limit` rows away."""
    o = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    w = Window.partitionBy(*by).orderBy(*o)
    frame = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(frame).alias(c) if c in columns else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, column: str, at: str, by: list[str]) -> DataFrame:
    """Linear interpolation over `at` between present values; after the last one it stays, before the first it is null."""
    w = Window.partitionBy(*by).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(column).isNotNull(), F.struct(F.col(at).alias("t"), F.col(column).alias("v")))
    a, b = F.last(here, True).over(back), F.first(here, True).over(ahead)
    x = df.withColumn("__a", a).withColumn("__b", b)
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(at) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    v = F.coalesce(F.col(column), F.when(F.col("__b").isNull(), F.col("__a.v")).when(F.col("__a").isNotNull(), line))
    return x.select(*[v.alias(c) if c == column else F.col(c) for c in df.columns])


# -- ranks and windows


def rank(df: DataFrame, column: str, method: str, by: list[str] | None = None, tie: list[str] | None = None, pct: bool = False, ascending: bool = True, name: str = "rank") -> DataFrame:
    """Rank by method average, min, max, first or dense; missing values have no rank. pct divides by the number ranked.

    Without `by` the rank is over the whole frame: values are counted first and their counts summed in ranges.
    """
    if not by:
        return _global_rank(df, column, method, tie, pct, ascending, name)
    o = F.col(column).asc() if ascending else F.col(column).desc()
    w, same = Window.partitionBy(F.col(column).isNull(), *by).orderBy(o), Window.partitionBy(*by, column)
    ties = F.count(F.lit(1)).over(same)
    low = F.rank().over(w)
    r = {"min": low, "max": low + ties - 1, "average": low + (ties - 1) / 2, "dense": F.dense_rank().over(w), "first": F.row_number().over(Window.partitionBy(F.col(column).isNull(), *by).orderBy(o, *(tie or [])))}[method].cast("double")
    if pct:
        whole = Window.partitionBy(F.col(column).isNull(), *by)
        r = r / (F.max(F.dense_rank().over(w)).over(whole) if method == "dense" else F.count(F.lit(1)).over(whole))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), r))


def _global_rank(df: DataFrame, column: str, method: str, tie: list[str] | None, pct: bool, ascending: bool, name: str) -> DataFrame:
    order = [F.col("__v").asc() if ascending else F.col("__v").desc()]
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    r = materialize(counts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "rank")
    sums = r.groupBy("__part").agg(F.sum("__n").alias("s"), F.count(F.lit(1)).alias("d"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select("__part", zero("s").alias("__s"), zero("d").alias("__d"))
    w = Window.partitionBy("__part").orderBy(*order)
    here = r.join(F.broadcast(sums), "__part")
    low = F.col("__s") + F.sum("__n").over(w) - F.col("__n") + 1
    ranks = here.select("__v", "__n", low.alias("__low"), (F.col("__d") + F.row_number().over(w)).alias("__dense"))
    x = df.join(ranks, df[column] == ranks["__v"], "left")
    if method == "first":
        x = x.withColumn("__first", F.row_number().over(Window.partitionBy("__v").orderBy(*(tie or [column]))))
        value = F.col("__low") + F.col("__first") - 1
    else:
        value = {"min": F.col("__low"), "max": F.col("__low") + F.col("__n") - 1, "average": F.col("__low") + (F.col("__n") - 1) / 2, "dense": F.col("__dense")}[method]
    value = value.cast("double")
    if pct:
        n, d = counts.agg(F.sum("__n"), F.count(F.lit(1))).first()
        value = value / F.lit(float((d if method == "dense" else n) or 1))
    return x.select(*[df[c] for c in df.columns], F.when(F.col("__v").isNotNull(), value).alias(name))


def rolling(df: DataFrame, column: str, order: list[str], by: list[str], rows: int | None, stats: list[str], min_periods: int | None = None) -> DataFrame:
    """Moving statistics over the last `rows` rows (all before, if null): roll_<stat>.

    Null where fewer than min_periods values are present (rows, or 1 for an open window).
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)
    c, n = F.col(column), F.count(column).over(w)
    need = min_periods if min_periods is not None else (1 if rows is None else rows)
    made = {
        "count": n, "sum": F.coalesce(F.sum(c).over(w), F.lit(0)), "mean": F.avg(c).over(w), "min": F.min(c).over(w), "max": F.max(c).over(w), "std": F.stddev_samp(c).over(w), "var": F.var_samp(c).over(w),
        "median": F.percentile(c, F.lit(0.5)).over(w), "skew": _skew(F.skewness(c).over(w), n), "kurt": _kurt(F.kurtosis(c).over(w), n),
    }
    return df.select("*", *[F.when(n >= need, made[s]).alias(f"roll_{s}") for s in stats])


def rolling_time(df: DataFrame, column: str, at: str, by: list[str], seconds: float, stats: list[str], closed: str = "right", min_periods: int = 1) -> DataFrame:
    """Moving statistics over the last `seconds` seconds up to each row, as roll_<stat>; closed as for intervals.

    Rows of one time see each other. Statistics: count, sum, mean, min, max, std, var, median.
    """
    us = int(round(seconds * 1_000_000))
    w = Window.partitionBy(*by).orderBy("__us").rangeBetween(-us if closed in ("left", "both") else 1 - us, 0 if closed in ("right", "both") else -1)
    c, n = F.col(column), F.count(column).over(w)
    made = {
        "count": n, "sum": F.sum(c).over(w), "mean": F.avg(c).over(w), "min": F.min(c).over(w), "max": F.max(c).over(w), "std": F.stddev_samp(c).over(w), "var": F.var_samp(c).over(w),
        "median": F.percentile(c, F.lit(0.5)).over(w),
    }
    x = df.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp")))
    return x.select("*", *[F.when(n >= min_periods, made[s]).alias(f"roll_{s}") for s in stats]).drop("__us")


def rolling_pair(df: DataFrame, a: str, b: str, order: list[str], by: list[str], rows: int | None, min_periods: int | None = None) -> DataFrame:
    """Moving covariance and correlation of two columns over the last `rows` rows: roll_cov, roll_corr."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)
    n = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(w)
    ok = (n >= F.lit(min_periods if min_periods is not None else (rows or 1))) & (n > 1)
    return df.select("*", F.when(ok, F.covar_samp(a, b).over(w)).alias("roll_cov"), F.when(ok, pearson(a, b, w)).alias("roll_corr"))


def rolling_bounds(df: DataFrame, order: list[str], by: list[str], first: int, last: int, made: dict) -> DataFrame:
    """Statistics over the rows from `first` to `last`, counted from each row: forward-looking, centred or lagging windows.

    made: name -> function of the window frame.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(first, last)
    return df.select("*", *[f(w).alias(n) for n, f in made.items()])


def rolling_apply(df: DataFrame, column: str, order: list[str], by: list[str], rows: int, f, name: str = "roll_apply", min_periods: int | None = None) -> DataFrame:
    """f of the array of present values among the last `rows` rows; the array holds no more than that."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    x = F.collect_list(column).over(w)
    return df.select("*", F.when(F.size(x) >= (rows if min_periods is None else min_periods), f(x)).alias(name))


def ewm_alpha(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    """The decay of exponential weights from just one of its four parameters."""
    given = [x for x in (com, span, halflife, alpha) if x is not None]
    if len(given) != 1:
        raise ValueError("give one of com, span, halflife and alpha")
    if com is not None:
        return 1 / (1 + com)
    if span is not None:
        return 2 / (span + 1)
    return 1 - math.exp(-math.log(2) / halflife) if halflife is not None else alpha


class _Decay:
    """Exponentially weighted sums of one group in order: weights, means and the co-moment of two series."""

    def __init__(self, alpha: float, adjust: bool):
        self.keep, self.new, self.adjust = 1 - alpha, 1.0 if adjust else alpha, adjust
        self.n = 0
        self.w = self.w1 = self.w2 = self.x = self.y = self.cov = 0.0

    def add(self, x: float | None, y: float | None) -> None:
        if self.n:
            self.w *= self.keep
            self.w1 *= self.keep
            self.w2 *= self.keep * self.keep
        if x is None or y is None:
            return
        new = self.new if self.n else 1.0
        self.n += 1
        w = self.w + new
        dx, dy = x - self.x, y - self.y
        part = new / w
        # the co-moment about the new means
        self.cov = (self.w / w) * (self.cov + part * dx * dy)
        self.x += part * dx
        self.y += part * dy
        self.w1, self.w2, self.w = self.w1 + new, self.w2 + new * new, w
        if not self.adjust:
            self.w1, self.w2, self.w = self.w1 / w, self.w2 / (w * w), 1.0

    def unbiased(self) -> float | None:
        gone = self.w1 * self.w1 - self.w2
        return self.cov * self.w1 * self.w1 / gone if self.n > 1 and gone > 1e-300 else None


def ewm(df: DataFrame, columns: list[str], order: list[str], by: list[str], alpha: float, stats: list[str], adjust: bool = True) -> DataFrame:
    """Exponentially weighted statistics as ewm_<stat>: mean, var, std (vol) of one column, cov and corr of two.

    Missing values keep what was so far and age the weights. A group is one fold in order: partitions are sorted and
    folded batch by batch, in time that grows with the rows and in constant memory, however large a group is.
    """
    pair = columns if len(columns) == 2 else columns * 2
    names = [f"ewm_{s}" for s in stats]
    sides = [("x", "x"), ("y", "y"), ("x", "y")]
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def run(batches):
        state, last = None, None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by))) if by else [()] * b.num_rows
            xs, ys = (b.column(c).cast("float64").to_pylist() for c in pair)
            out: list[list] = [[] for _ in names]
            for key, x, y in zip(keys, xs, ys):
                if state is None or key != last:
                    state, last = {s: _Decay(alpha, adjust) for s in sides}, key
                x, y = (None if v is None or v != v else v for v in (x, y))
                for s in sides:
                    both = x is not None and y is not None
                    state[s].add(*((x if s[0] == "x" else y, x if s[1] == "x" else y) if both or len(columns) == 1 else (None, None)))
                m, var = state["x", "x"], state["x", "x"].unbiased()
                made = {"mean": m.x if m.n else None, "var": var, "std": None if var is None else math.sqrt(max(0.0, var))}
                made["vol"] = made["std"]
                if "cov" in stats or "corr" in stats:
                    cov, vy = state["x", "y"].unbiased(), state["y", "y"].unbiased()
                    made["cov"] = cov
                    made["corr"] = cov / math.sqrt(var * vy) if cov is not None and var and vy and var * vy > 0 else None
                for o, s in zip(out, stats):
                    o.append(made[s])
            yield pa.record_batch([*b.columns, *[pa.array(o, pa.float64()) for o in out]], names=[*b.schema.names, *names])

    placed = df.repartition(*by) if by else df.coalesce(1)
    return placed.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def ewm_mean(df: DataFrame, column: str, order: list[str], by: list[str], alpha: float) -> DataFrame:
    """Exponentially weighted mean with adjusted weights, as `ewm_mean`."""
    return ewm(df, [column], order, by, alpha, ["mean"])


def cumulative(df: DataFrame, column: str, order: list[str], by: list[str], stats: list[str]) -> DataFrame:
    """Running sum, prod, min, max and count as cum_<stat>; rows with a missing value stay missing."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(column)
    made = {"sum": F.sum(c).over(w), "min": F.min(c).over(w), "max": F.max(c).over(w), "prod": F.product(c).over(w), "count": F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1}
    return df.select("*", *[(made[s] if s == "count" else F.when(c.isNotNull(), made[s])).alias(f"cum_{s}") for s in stats])


# -- statistics


def pearson(a: str, b: str, over=None) -> Column:
    """Correlation over the rows where both are present; null where a column doesn't vary (corr would divide by zero)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    made = F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)
    cov, sx, sy = (m if over is None else m.over(over) for m in made)
    return F.try_divide(cov, sx * sy)


def _skew(population: Column, n: Column) -> Column:
    return F.when(n > 2, population * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def _kurt(population: Column, n: Column) -> Column:
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * population + 6))


def skew(column: str) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    return _skew(F.skewness(column), F.count(column))


def kurt(column: str) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    return _kurt(F.kurtosis(column), F.count(column))


def sem(column: str) -> Column:
    return F.stddev_samp(column) / F.sqrt(F.count(column))


def total(column: str) -> Column:
    """Sum; 0 of nothing."""
    return F.coalesce(F.sum(column), F.lit(0))


def mode(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """All most frequent values: (by, column, n)."""
    by = by or []
    n = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*by).agg(F.max("n").alias("n")) if by else n.agg(F.max("n").alias("n"))
    return n.join(F.broadcast(best) if not by else best, [*by, "n"]).select(*by, column, "n")


def mean_absolute_deviation(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, mad): mean distance from the mean; two passes, the second behind a join of the means."""
    m = df.groupBy(*by).agg(F.avg(column).alias("__m"))
    return df.join(m, by).groupBy(*by).agg(F.avg(F.abs(F.col(column) - F.col("__m"))).alias("mad"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, spearman): correlation of average ranks over rows where both are present."""
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = rank(rank(x, a, "average", by, name="__ra"), b, "average", by, name="__rb")
    return x.groupBy(*by).agg(pearson("__ra", "__rb").alias("spearman"))


def value_counts(df: DataFrame, column: str, normalize: bool = False, dropna: bool = True) -> DataFrame:
    """(column, n[, share])."""
    x = df.filter(F.col(column).isNotNull()) if dropna else df
    n = x.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())) if normalize else n


def quantile(df: DataFrame, column: str, q: float, by: list[str], how: str = "linear") -> DataFrame:
    """(by, quantile): linear, lower, higher, midpoint or nearest (half to even)."""
    if how == "linear":
        return df.groupBy(*by).agg(F.percentile(column, F.lit(q)).alias("quantile"))
    x = df.filter(F.col(column).isNotNull())
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(column)) - 1).withColumn("__at", F.lit(q) * (F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1))
    low, high = F.floor("__at"), F.ceil("__at")
    if how == "midpoint":
        return x.filter((F.col("__i") == low) | (F.col("__i") == high)).groupBy(*by).agg(F.avg(column).alias("quantile"))
    at = {"lower": low, "higher": high, "nearest": F.rint("__at")}[how]
    return x.filter(F.col("__i") == at).groupBy(*by).agg(F.first(column).alias("quantile"))


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column: a row per group and column."""
    long = df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*(by or []), "x.*")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = long.groupBy(*(by or []), "column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), q.alias("q"), F.max("v").alias("greatest"))
    return g.select(*(by or []), "column_name", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "greatest")


# -- reshaping


def pivot_table(df: DataFrame, index: list[str], columns: str, values: list, agg: Column, fill=None, margin: str | None = None) -> DataFrame:
    """Wide table of `agg` by index and the given values of `columns`; margin names an extra column of row totals."""
    wide = df.filter(F.col(columns).isin(values)).groupBy(*index).pivot(columns, values).agg(agg)
    wide = wide if fill is None else wide.fillna(fill, [str(v) for v in values])
    if margin:
        wide = wide.join(df.filter(F.col(columns).isin(values)).groupBy(*index).agg(agg.alias(margin)), index)
    return wide


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, var, value)


def wide_to_long(df: DataFrame, stub: str, ids: list[str], sep: str = "_", j: str = "j") -> DataFrame:
    """Columns stub<sep><j> as rows (ids, j, stub)."""
    found = [c for c in df.columns if c.startswith(stub + sep)]
    return df.unpivot(ids, found, "__v", stub).withColumn(j, F.substring("__v", len(stub + sep) + 1, 1_000)).drop("__v")


def get_dummies(df: DataFrame, column: str, values: list, prefix: str) -> DataFrame:
    """An indicator column prefix_<value> (0 or 1) per value, instead of `column`; missing values are 0 everywhere."""
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values])


def cut(c: Column, edges: list[float], right: bool = True, include_lowest: bool = False) -> Column:
    """0-based number of the bin; null outside of all."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = ((c > a) & (c <= b)) if right else ((c >= a) & (c < b))
        if include_lowest and right and i == 0:
            inside = inside | (c == a)
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def qcut(df: DataFrame, column: str, q: int, name: str = "bin") -> DataFrame:
    """Bins of equal counts by exact quantiles (one row of q + 1 numbers at the driver)."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / q) for i in range(q + 1)]))).first()[0]
    return df.withColumn(name, cut(F.col(column), edges, True, True)) if edges else df.withColumn(name, F.lit(None).cast("int"))


def concat(frames: list[DataFrame], keys: list[str] | None = None, join: str = "outer") -> DataFrame:
    """Frames under each other; inner keeps common columns only; keys adds `part`."""
    if join == "inner":
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*common) for f in frames]
    if keys:
        frames = [f.withColumn("part", F.lit(k)) for f, k in zip(frames, keys)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(frames: list[DataFrame], index: list[str], keys: list[str], join: str = "outer") -> DataFrame:
    """Frames beside each other on their index; columns are named <key>_<column>. Index labels must be unique."""
    named = [f.select(*index, *[F.col(c).alias(f"{k}_{c}") for c in f.columns if c not in index]) for f, k in zip(frames, keys)]
    return reduce(lambda a, b: a.join(b, index, "full" if join == "outer" else "inner"), named)


def crosstab(df: DataFrame, row: str, column: str, values: list, normalize: bool | str = False, margins: bool = False) -> DataFrame:
    """Counts of column values per row value; normalize gives shares of all, or of the row (index) or the column (columns).

    With margins a column `All` and, of string rows, a row `All`.
    """
    x = df.filter(F.col(row).isNotNull() & F.col(column).isin(values))
    wide = df.filter(F.col(row).isNotNull()).groupBy(row).pivot(column, values).count().fillna(0)
    q = lambda v: F.col(f"`{v}`")
    all_ = sum((q(v) for v in values), F.lit(0))
    if margins:
        sums = wide.agg(*[F.coalesce(F.sum(q(v)), F.lit(0)).alias(str(v)) for v in values]).select(F.lit("All").alias(row), *[q(v) for v in values])
        wide = wide.unionByName(sums).withColumn("All", all_)
    if not normalize:
        return wide
    shown = [*values, *(["All"] if margins else [])]
    if normalize == "index":
        return wide.select(row, *[F.try_divide(q(v), all_).alias(str(v)) for v in shown])
    if normalize == "columns":
        per = x.groupBy().pivot(column, values).count().fillna(0).first()
        n = {**{v: (per[str(v)] if per else 0) for v in values}, "All": x.count() if margins else 0}
        return wide.select(row, *[(q(v) / F.lit(max(n[v], 1))).alias(str(v)) for v in shown])
    n = x.count()
    return wide.select(row, *[(q(v) / F.lit(max(n, 1))).alias(str(v)) for v in shown])


def factorize(df: DataFrame, column: str, order: str, name: str = "code") -> DataFrame:
    """Rows with a 0-based code in order of first appearance; missing values have -1. Distinct values are numbered alone."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))
    codes = position(first, ["__first", column], name).drop("__first")
    return df.join(codes, column, "left").fillna(-1, [name])


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Columns as rows: for small frames of one type."""
    return df.transpose(F.col(index))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one pass."""
    got = df.agg(*[pearson(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("corr")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j])).alias("x")).select("x.*")


# -- time


def bucket(at: str, rule: str, closed: str = "left", label: str = "left", offset: str | None = None) -> Column:
    """The time bucket of a row: closed on the left (a time on an edge belongs to the later bucket) or on the right.

    Labelled by its start or its end; edges are multiples of the rule from the epoch, moved by `offset`.
    """
    t = F.col(at) if closed == "left" else F.col(at) - F.expr("INTERVAL 1 MICROSECOND")
    w = F.window(t, rule, rule, offset) if offset else F.window(t, rule)
    return w.start if label == "left" else w.end


def resample(df: DataFrame, at: str, rule: str, aggs: dict[str, Column], by: list[str] | None = None, closed: str = "left", label: str = "left", offset: str | None = None) -> DataFrame:
    """Aggregates per time bucket, as `bucket` (see there)."""
    return df.groupBy(*(by or []), bucket(at, rule, closed, label, offset).alias("bucket")).agg(*[e.alias(n) for n, e in aggs.items()])


def resample_transform(df: DataFrame, at: str, rule: str, made: dict, by: list[str] | None = None, **how) -> DataFrame:
    """Rows with values computed over their bucket; made: name -> function of the bucket's window."""
    x = df.withColumn("bucket", bucket(at, rule, **how))
    w = Window.partitionBy(*(by or []), "bucket")
    return x.select("*", *[f(w).alias(n) for n, f in made.items()])


def upsample(df: DataFrame, at: str, every: str, by: list[str] | None = None, limits: tuple | None = None) -> DataFrame:
    """All buckets between the first and the last of each group, those without a row with nulls."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    spine = ends.select(*by, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {every}"))).alias(at))
    return spine.join(df, [*by, at], "left")


def ohlc(df: DataFrame, at: str, rule: str, value: str, by: list[str] | None = None) -> DataFrame:
    """First, highest, lowest and last value of each bucket."""
    return resample(df, at, rule, {"open": F.min_by(value, at), "high": F.max(value), "low": F.min(value), "close": F.max_by(value, at)}, by)


def between_time(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows whose time of day (HH:mm:ss) lies in [start, end]; over midnight if start > end."""
    t = F.date_format(at, "HH:mm:ss")
    return df.filter((t >= start) & (t <= end) if start <= end else (t >= start) | (t <= end))
