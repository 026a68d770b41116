"""Joins beyond the equi-join: null-safe merges, as-of joins, range and stabbing joins.

An as-of join is one shuffle: both sides are put under each other and the last right row is carried along a window. A
range join bins the intervals, so that it is an equi-join on the bin with the exact predicate behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), indicator: bool = False, validate: str | None = None) -> DataFrame:
    """Join on equal keys where null keys match each other; clashing other columns get the suffixes.

    how: inner, left, right, outer, semi, anti, cross is not offered. indicator adds `merge_side` (left_only,
    right_only, both). validate: one_to_one, one_to_many or many_to_one raise where keys repeat on a "one" side.
    """
    for side, df, tags in (("left", left, ("one_to_one", "one_to_many")), ("right", right, ("one_to_one", "many_to_one"))):
        if validate in tags and not df.groupBy(*on).count().filter("count > 1").isEmpty():
            raise ValueError(f"merge keys of the {side} side are not unique")
    if how in ("semi", "anti"):
        r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on]).distinct()
        return left.join(r, _same(left, on), f"left_{how}")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    l2 = left.select(*[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns], F.lit(1).alias("__l"))
    r2 = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c + suffixes[1] if c in clash else c) for c in right.columns], F.lit(1).alias("__r"))
    j = l2.join(r2, _same(l2, on), {"outer": "full_outer"}.get(how, how))
    keys = [F.when(F.col("__l").isNotNull(), F.col(c)).otherwise(F.col(f"__r_{c}")).alias(c) for c in on]
    rest = [F.col(c) for c in l2.columns if c not in on and c != "__l"] + [F.col(c) for c in r2.columns if not c.startswith("__r")]
    side = [F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both").alias("merge_side")] if indicator else []
    return j.select(*keys, *rest, *side)


def _same(left: DataFrame, on: list[str]) -> Column:
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(F.col(f"__r_{c}"))
    return cond


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", tolerance: Column | None = None, exact: bool = True, id_col: str | None = None) -> DataFrame:
    """Each left row with `values` (and `on` as `right_<on>`) of the nearest right row in its group.

    backward: the last right row at or before; forward: the first at or after; nearest: the closer of both, the earlier
    one on a tie. exact=False leaves out right rows at the very key. Right rows with equal keys: the one with the
    largest values counts backward and forward alike. Beyond `tolerance` (same kind as a difference of `on`), without
    a match and for a null key the values are null. id_col must tell left rows apart for `nearest`.
    """
    if direction == "nearest":
        key = id_col or on
        b = asof(left, right, on, by, values, "backward", tolerance, exact)
        f = asof(left, right, on, by, values, "forward", tolerance, exact).select(key, *[F.col(c).alias(f"__f_{c}") for c in [*values, f"right_{on}"]])
        j = b.join(f.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
        back, ahead = _distance(F.col(on), F.col(f"right_{on}")), _distance(F.col(f"__f_right_{on}"), F.col(on))
        take = F.coalesce(back <= ahead, F.col(f"right_{on}").isNotNull())
        return j.select(*left.columns, *[F.when(take, F.col(c)).otherwise(F.col(f"__f_{c}")).alias(c) for c in [*values, f"right_{on}"]])
    right = right.filter(F.col(on).isNotNull()).select(*by, F.col(on), F.lit(1).alias("__side"), F.struct(F.col(on).alias(f"right_{on}"), *values).alias("__v"))
    r = right.groupBy(*by, on, "__side").agg(F.max("__v").alias("__v"))
    # with the exact key allowed, right rows come before left ones in the order of the carry
    side = F.lit(2 if exact else 0)
    l2 = left.withColumn("__side", side)
    both = l2.unionByName(r, allowMissingColumns=True)
    order = [F.col(on).asc(), F.col("__side").asc()] if direction == "backward" else [F.col(on).desc(), F.col("__side").asc()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = F.when(F.col(on).isNotNull(), F.last("__v", ignorenulls=True).over(w))
    if tolerance is not None:
        d = _distance(F.col(on), F.col("__v")[f"right_{on}"]) if direction == "backward" else _distance(F.col("__v")[f"right_{on}"], F.col(on))
    out = both.withColumn("__v", got).filter(F.col("__side") != 1)
    if tolerance is not None:
        out = out.withColumn("__v", F.when(d <= tolerance, F.col("__v")))
    return out.select(*left.columns, *[F.col("__v")[c].alias(c) for c in [*values, f"right_{on}"]])


def _distance(a: Column, b: Column) -> Column:
    return a - b


def ordered_merge(left: DataFrame, right: DataFrame, on: str, fill: bool = False) -> DataFrame:
    """Outer merge in the order of `on`; with fill, missing values are taken from the row before. Rows without a key are not filled."""
    j = merge(left, right, [on], "outer")
    if not fill:
        return j
    from quillstone.operators.frame import global_ffill

    return global_ffill(j.filter(F.col(on).isNotNull()), [c for c in j.columns if c != on], [on]).unionByName(j.filter(F.col(on).isNull()))


def stab(points: DataFrame, items: DataFrame, at: str, start: str, end: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Points with the items that hold them (start <= at < end): both sides' columns.

    Items are put into every bin of `width` that they touch, points into one: an equi-join on the bin (and `by`). The
    width should be near the median length of an item. Empty items hold nothing; null ends drop out.
    """
    by = by or []
    b = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    it = items.filter(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(b(start), F.floor((F.col(end) - 1) / F.lit(width)).cast("long"))))
    return points.withColumn("__bin", b(at)).join(it, [*by, "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def overlaps(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Pairs of half-open intervals that overlap. Each pair comes from the bin where its overlap begins, once."""
    by = by or []
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width).cast("long"), F.floor((F.col(e) - 1) / width).cast("long")))
    a = left.filter(F.col(l_start) < F.col(l_end)).withColumn("__bin", bins(l_start, l_end))
    b = right.filter(F.col(r_start) < F.col(r_end)).withColumn("__bin", bins(r_start, r_end))
    first = F.floor(F.greatest(l_start, r_start) / width).cast("long")
    return a.join(b, [*by, "__bin"]).filter((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)) & (F.col("__bin") == first)).drop("__bin")
