"""Dataflow over keyed records: support counts, ranking, scheduling, pairs and splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.operators.frame import position


# -- deduplication and support


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key by seq, with `first_seq`, the place of its first."""
    g = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("r"), F.min(seq).alias("first_seq"))
    return g.select("r.*", "first_seq")


def collapse(df: DataFrame, predicate: Column, seq: str) -> DataFrame:
    """Of the rows that meet the predicate the first by seq; all other rows."""
    hit = F.coalesce(predicate, F.lit(False))
    first = df.filter(hit).agg(F.min(seq).alias("__s"))
    return df.filter(~hit).unionByName(df.filter(hit).join(F.broadcast(first), F.col(seq) == F.col("__s"), "left_semi"))


def support(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Each key once, its last record with the number of records as `support`."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("support"), F.max_by(F.struct(*[c for c in df.columns if c != key]), seq).alias("r"))
    return g.select(key, "support", "r.*")


def group_support(df: DataFrame, group: str, weight: str, seq: str) -> DataFrame:
    """(group, support, first_seq, place): groups by falling support, ties in order of appearance."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("support"), F.min(seq).alias("first_seq"))
    g = g.withColumn("__d", -F.col("support"))
    return position(g, ["__d", "first_seq", group], "place").drop("__d")


def collect_groups(df: DataFrame, group: str, item: str, limit: int | None = None) -> DataFrame:
    """(group, items): sorted items per group; with a limit the least `limit` of them, which bounds every row."""
    if limit is not None:
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(item))).filter(F.col("__n") <= limit)
    return df.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))


def signature_counts(df: DataFrame, owner: str, kind: str) -> DataFrame:
    """(owner, signature): the multiset of kinds per owner as sorted (kind, n)."""
    n = df.groupBy(owner, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct(kind, "n"))).alias("signature"))


# -- resuming


def remaining(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks that are not done."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def requested(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks that are done."""
    return tasks.join(done.select(key).distinct(), key, "left_semi")


def processed(success: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    return success.select(key).union(failed.select(key)).distinct()


def merge_campaigns(parts: list[DataFrame], key: str) -> DataFrame:
    """All records of all campaigns; a key in two of them raises when the result is computed."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = whole.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))))
    return checked.filter(F.col("__ok").isNull()).drop("__n", "__ok")


# -- scheduling


def shuffled(df: DataFrame, key: str, seed: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A repeatable permutation with `place`; offset and limit cut a slice of it."""
    x = position(df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))), ["__h", key], "place").drop("__h").filter(F.col("place") >= offset)
    return x if limit is None else x.filter(F.col("place") < offset + limit)


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with the number of their chunk of `size` rows."""
    return position(df, order, "__p").withColumn("chunk", F.floor(F.col("__p") / size).cast("long")).drop("__p")


def round_robin(df: DataFrame, group: str, rank: str, order: list[str]) -> DataFrame:
    """Rows with `round`: the n-th row of every group in round n; serve by (round, rank)."""
    return df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def cyclic_rounds(df: DataFrame, group: str, order: list[str], rounds: int) -> DataFrame:
    """(group, round, row columns): `rounds` rows per group, short groups starting over."""
    x = df.withColumn("__i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group))).filter(F.col("__i") < rounds)
    x = x.withColumn("round", F.explode(F.expr(f"filter(sequence(0, {rounds - 1}), r -> r % __n = __i)")))
    return x.drop("__i", "__n")


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of an order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows with `part`: train for `share` of the keys by hash, else test; a key never changes sides."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    return df.withColumn("part", F.when(u < share, "train").otherwise("test"))


# -- pairs (A41, A42)


def pairs_within(df: DataFrame, group: str, item: str, span: int) -> DataFrame:
    """(group, a, b): each item with the next `span` of its group in order; rows grow with span, not with the group."""
    w = Window.partitionBy(group).orderBy(item)
    later = F.array(*[F.lead(item, k).over(w) for k in range(1, span + 1)])
    return df.select(group, F.col(item).alias("a"), later.alias("l")).select(group, "a", F.explode("l").alias("b")).filter(F.col("b").isNotNull())


def negatives(df: DataFrame, group: str, item: str, per_item: int, seed: int = 0) -> DataFrame:
    """(item, other, turn): for each item `per_item` items of other groups, all different, as far as there are any.

    Groups are put one behind the other and items shuffled within them. The k-th negative is that at the item's own place
    among all items of other groups (its place in the shuffled frame), moved on by k - 1 steps: the other groups are the
    order without the item's own stretch, so that no turn is lost whatever the groups' sizes. No product of groups.
    """
    md = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")))
    x = position(df.select(group, item).filter(F.col(group).isNotNull()).withColumn("__h", md), [group, "__h", item], "__p")
    x = position(x, ["__h", item], "__r")
    n = x.count()
    sizes = x.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.min("__p").alias("__first"))
    a = x.join(sizes, group).withColumn("__others", F.lit(n) - F.col("__n")).filter("__others > 0")
    turns = F.least(F.lit(per_item).cast("long"), F.col("__others"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__others") / turns))
    a = a.select(group, item, "__r", "__n", "__first", "__others", step.alias("__step"), F.explode(F.sequence(F.lit(1).cast("long"), turns)).alias("turn"))
    at = F.pmod(F.col("__r") + (F.col("turn") - 1) * F.col("__step"), F.col("__others"))
    a = a.select(item, F.col("turn").cast("int").alias("turn"), F.when(at < F.col("__first"), at).otherwise(at + F.col("__n")).alias("__to"))
    return a.join(x.select(F.col(item).alias("other"), F.col("__p").alias("__to")), "__to").select(item, "other", "turn")


# -- reports


def length_report(df: DataFrame, column: str) -> DataFrame:
    """mean, median, min, max and percentiles of text length."""
    n = F.length(column)
    p = F.percentile(n, F.array(*[F.lit(q) for q in (0.5, 0.75, 0.9, 0.99)]))
    g = df.agg(F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("greatest"), p.alias("p"))
    return g.select("mean", "least", "greatest", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((50, 75, 90, 99))])


def cumulative_rate(df: DataFrame, attempts: str, solved: Column) -> DataFrame:
    """(attempts, n, solved_by_then, rate): share of all rows solved with at most so many attempts."""
    g = df.groupBy(attempts).agg(F.count_if(solved).alias("n"), F.count(F.lit(1)).alias("all_"))
    w = Window.orderBy(attempts).rowsBetween(Window.unboundedPreceding, 0)  # one row per number of attempts
    return g.select(attempts, "n", F.sum("n").over(w).alias("solved_by_then"), (F.sum("n").over(w) / F.sum("all_").over(Window.partitionBy())).alias("rate"))


def outcome_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


# -- filters


def all_of(predicates: Iterable[Column]) -> Column:
    """Predicates joined by and; none at all is true, an unknown one false."""
    out = F.lit(True)
    for p in predicates:
        out = out & F.coalesce(p, F.lit(False))
    return out


def uses_all(have: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]).cast("array<string>"), have)) == 0


def uses_none(have: Column, barred: list[str]) -> Column:
    return ~F.arrays_overlap(have, F.array(*[F.lit(x) for x in barred]).cast("array<string>"))


def sliding_sum(df: DataFrame, at: str, value: str, seconds: int, by: list[str] | None = None) -> DataFrame:
    """Rows with `in_window`: the sum of `value` over the last `seconds` seconds up to the row, its own included."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    us = seconds * 1_000_000
    if by:
        w = Window.partitionBy(*by).orderBy("__t").rangeBetween(1 - us, 0)
        return df.withColumn("__t", t).withColumn("in_window", F.sum(value).over(w)).drop("__t")
    # over the whole frame: spans of the window's own length, each with a copy of the rows of the span before
    x = df.withColumn("__t", t).withColumn("__s", F.floor(F.col("__t") / us))
    x = x.withColumn("__c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__s", F.col("__s") + F.col("__c"))
    w = Window.partitionBy("__s").orderBy("__t").rangeBetween(1 - us, 0)
    return x.withColumn("in_window", F.sum(value).over(w)).filter("__c = 0").drop("__t", "__s", "__c")


def zip_results(tasks: DataFrame, results: DataFrame, task_id: str) -> DataFrame:
    """Tasks with their results by id, so that a task without one shifts nothing; both ids must be unique."""
    from quillstone.operators.joins import merge

    return merge(tasks, results, [task_id], "left", validate="one_to_one")


def unsolved(baseline: DataFrame, run: DataFrame, key: str, solved: str) -> DataFrame:
    """Records of a run whose key the baseline has and has not solved."""
    return run.join(baseline.filter(~F.coalesce(F.col(solved), F.lit(False))).select(key).distinct(), key, "left_semi")


def penalised(history: DataFrame, group: str, ok: str, turn: str, errors: int = 3, rounds: int = 50) -> DataFrame:
    """(group, blocked_until): groups that failed `errors` times since their last success, and the turn up to which they wait.

    history: one row per attempt in order of turn. A scheduler serves a group again from blocked_until on.
    """
    w = Window.partitionBy(group).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    x = history.withColumn("__s", F.coalesce(F.sum(F.col(ok).cast("int")).over(w), F.lit(0)))
    x = x.withColumn("__e", F.sum((~F.coalesce(F.col(ok), F.lit(False))).cast("int")).over(Window.partitionBy(group, "__s").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)))
    last = x.groupBy(group).agg(F.max_by(F.struct(F.col(turn).alias("t"), F.col("__e").alias("e")), turn).alias("l"))
    return last.filter((F.col("l.e") > 0) & (F.col("l.e") % errors == 0)).select(group, (F.col("l.t") + rounds).alias("blocked_until"))
