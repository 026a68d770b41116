"""Mixing sources to target weights by weighted fair queueing.

Each copy of a document gets a virtual finish time: the tokens of its source up to and including it, in the shuffled
order of the source, divided by the source's target share. Serving copies by finish time keeps every source at its
share until its copies run out; from then on the others share what is left in proportion. The mix is the prefix of
that order whose tokens fit into the budget.

All running sums are two-level: within a source, rows fall into buckets of about ROWS rows by their shuffled place;
over the whole mix, rows are ranged by finish time (ranges of equal numbers of rows, whatever the times). Buckets and
ranges are summed, the few sums are prefix-summed, and rows are prefix-summed inside their bucket or range only. A
source with a third of all rows is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.llm import bpe
from quillstone.session import materialize

#: Rows of a bucket, of which one task makes a running sum.
ROWS = 50_000
#: Targets are broadcast up to so many rows, and joined by a shuffle beyond.
MAX_TARGETS = 10_000


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that shuffles rows the same way on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _few(df: DataFrame) -> DataFrame:
    """`df`, a row per target source, broadcast if it has at most MAX_TARGETS rows."""
    return F.broadcast(df) if df.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS else df


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` up to each row, per `groups` in the order (bucket, *order); one task per bucket."""
    own = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*groups, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return df.withColumn("_own", F.sum(value).over(own)).join(sums, [*groups, bucket]).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before")


def last_finish(held: DataFrame, budget: int) -> float:
    """The virtual time up to which all copies together come to `budget` tokens, or the end of all copies.

    held: a row per source with tokens (held), target_share and max_repeats. Up to a time t a source serves
    min(t * share, held * repeats) tokens; the sum is piecewise linear with a bend where a source runs out.
    """
    x = held.select("target_share", (F.col("held") * F.col("max_repeats")).alias("most")).withColumn("out_at", F.col("most") / F.col("target_share"))
    w = Window.orderBy("out_at", "most").rowsBetween(Window.unboundedPreceding, 0)  # a row per target
    x = x.withColumn("gone", F.sum("most").over(w)).withColumn("shares_gone", F.sum("target_share").over(w))
    all_ = held.agg(F.sum("target_share")).first()[0] or 0.0
    served = F.col("gone") + F.col("out_at") * F.greatest(F.lit(0.0), F.lit(all_) - F.col("shares_gone"))
    x = x.withColumn("served", served)
    bend = x.filter(F.col("served") >= F.lit(budget)).agg(F.min("out_at").alias("t")).first()[0]
    if bend is None:
        return float(x.agg(F.max("out_at")).first()[0] or 0.0)
    # before the bend: what had run out by then, and the others at their shares
    r = x.filter(F.col("out_at") < F.lit(bend)).agg(F.coalesce(F.max("gone"), F.lit(0)), F.coalesce(F.max("shares_gone"), F.lit(0.0))).first()
    left = all_ - r[1]
    return min(bend, max(0.0, (budget - r[0]) / left)) if left > 1e-12 else float(bend)


def fair_mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, rows: int = ROWS) -> DataFrame:
    """(source, doc_id, copy, n_tokens, finish, total): the copies in the mix; `total` counts tokens up to each.

    docs: source, doc_id (unique), n_tokens. targets: source, target_share, max_repeats. The budget is the number of
    tokens that documents of target sources hold once, unless given. Documents without tokens, of no target source or
    of a null source take no part; nor do targets without a positive share and repeat. Of repeated targets of one
    source the largest counts. Empty inputs give an empty mix; extra columns are ignored.
    """
    t = targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    t = t.select("source", "t.target_share", "t.max_repeats")
    d = docs.filter(F.col("n_tokens") > 0).select("source", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    held = materialize(d.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n")).join(t, "source"), "p9h")
    once, longest = held.agg(F.sum("held")).first()[0], d.agg(F.max("n_tokens")).first()[0]
    budget = budget if budget is not None else once or 0
    end = last_finish(held, budget + (longest or 0)) if once else 0.0
    # no copy beyond the one in which its source passes the end of the budget is made at all; one more for rounding
    passes = F.least(F.col("max_repeats"), F.floor(F.lit(end) * F.col("target_share") / F.col("held")) + 2).cast("int")
    x = d.join(_few(held), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    x = x.withColumn("u", _unit(F.lit(seed), F.col("copy"), F.col("doc_id"))).withColumn("b", F.floor(F.col("u") * F.ceil(F.col("n") / F.lit(rows))))
    x = running_sum(x, ["source", "copy"], "b", ["u", "doc_id"], "n_tokens", "cum")
    x = x.withColumn("finish", (F.col("copy") * F.col("held") + F.col("cum")) / F.col("target_share"))
    order = ["finish", "source", "doc_id", "copy"]
    ranged = x.select("source", "doc_id", "copy", "n_tokens", "finish").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("all_", F.lit(0)), "p9r")
    total = running_sum(ranged, ["all_"], "part", order, "n_tokens", "total")
    return total.filter(F.col("total") <= F.lit(budget)).select("source", "doc_id", "copy", "n_tokens", "finish", "total")


def sized_documents(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(source, doc_id, n_tokens) of the documents of target sources; sizes in tokens of the public tokenizer."""
    wanted = docs.select("source", "doc_id", "text").join(_few(targets.select("source").distinct()), "source", "left_semi")
    key = wanted.select(F.struct("source", "doc_id").alias("k"), "text")
    return bpe.encode_table(key, "k", "text", path, counts_only=True).select("k.source", "k.doc_id", "n_tokens")


def shares(mix: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source came to: one row per target, sources without documents included (share 0)."""
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_docs"), F.max("copy").alias("last"), F.count(F.lit(1)).alias("n_copies"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    total = mix.agg(F.sum("n_tokens")).first()[0] or 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        targets.select("source", "target_share", "max_repeats").join(_few(used), "source", "left").join(_few(have), "source", "left")
        .select("source", "target_share", (zero("tokens") / F.lit(max(total, 1))).alias("actual_share"), zero("tokens"), zero("held"), zero("n_docs"), zero("n_copies"), (F.coalesce(F.col("last") + 1, F.lit(0))).cast("int").alias("repeats"), "max_repeats")
    )


def prepare(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """The sizes, written once: texts are tokenized a single time."""
    return materialize(sized_documents(docs, targets, path), "p9")
