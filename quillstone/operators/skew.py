"""Per-key results where a few keys hold most records.

Heavy keys are found with a mergeable counter sketch (Misra-Gries), counted exactly behind a broadcast of the few
candidates, and the light rest goes through an ordinary shuffle. Heavy rows never meet in one task: they are
pre-aggregated where they lie, so that each task sends one row per heavy key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Heavy candidates, at most 4 / (3 phi), are broadcast up to so many, and joined by a shuffle beyond.
MAX_CANDIDATES = 10_000
_HOLDS_ROWS = re.compile(r"\b(?:collect_list|collect_set|array_agg|percentile|median|mode|listagg|string_agg)\(", re.I)
#: White space as Unicode has it, for trimming (Java's `\s` alone knows only ASCII).
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(c: Column) -> Column:
    """`c` without surrounding Unicode white space; null stays null."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per `key`: re-delivered records (equal content) count once. Null keys are one record each."""
    null = df.filter(F.col(key).isNull())
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(null)


def misra_gries(keys: Iterator[str | None], k: int) -> dict[str, int]:
    """At most `k` counters; a key that occurs more than n / (k + 1) times among n keeps a counter."""
    c: Counter = Counter()
    for batch in keys:
        c.update(batch)
        if len(c) > k:  # batched form: take away the (k+1)-th largest count from every counter
            cut = sorted(c.values(), reverse=True)[k]
            c = Counter({x: n - cut for x, n in c.items() if n > cut})
    return dict(c)


def collect_heavy(df: DataFrame, key: str, phi: float, total: int | None = None) -> list[str]:
    """A superset of the keys that hold at least the share `phi` of the rows of `df`, at most 4 / (3 phi) of them.

    Each task sends at most 4 / phi counters; merged counters lose at most n * phi / 4 each, so a key at the
    share phi still shows at least 3/4 of it. `key` must be a string column; null keys are no keys.
    """
    k = max(1, int(4 / phi))
    total = df.count() if total is None else total

    def sketch(batches):
        counters = misra_gries(([x for x in b.column(0).to_pylist() if x is not None] for b in batches), k)
        yield pa.record_batch([pa.array([*counters], pa.string()), pa.array([*counters.values()], pa.int64())], names=["heavy_key", "seen"])

    merged = df.select(F.col(key).alias("heavy_key")).mapInArrow(sketch, "heavy_key string, seen long").groupBy("heavy_key").agg(F.sum("seen").alias("seen"))
    return [r[0] for r in merged.filter(F.col("seen") >= total * phi * 0.75).collect()]


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_CANDIDATES else df


def heavy_keys(df: DataFrame, key: str, phi: float) -> DataFrame:
    """The keys that hold at least the share `phi` of all rows of `df`, exactly: (key, n_rows).

    Rows with a null key count in the total but are no key. Empty input: no rows. Ties at exactly `phi` count.
    """
    spark = df.sparkSession
    total = df.count()
    found = collect_heavy(df, key, phi, total)
    small = _few(spark.createDataFrame([(x,) for x in found], f"{key} string"), len(found))
    counted = df.select(key).join(small, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(F.col("n_rows") >= F.lit(phi) * F.lit(float(total)))


def aggregate_skewed(df: DataFrame, key: str, aggs: dict[str, Column], phi: float = 0.01) -> DataFrame:
    """`df.groupBy(key).agg(...)` without the imbalance of heavy keys.

    Heavy keys (share `phi` or more): broadcast join with the candidates, grouped with a partial aggregate per
    task. Others: ordinary shuffle. Both parts are unioned; every key is in just one. Null keys are left out.
    Aggregates whose state holds all rows of a key (collect_list, percentile and the like) gain nothing from partial
    aggregation: a heavy key would meet in one task after all, so they raise ValueError.
    """
    for n, e in aggs.items():
        if _HOLDS_ROWS.search(str(e)):
            raise ValueError(f"{n} gathers all rows of a key")
    spark = df.sparkSession
    schema = df.schema[key].dataType
    tagged = df.filter(F.col(key).isNotNull())
    names = collect_heavy(tagged.select(F.col(key).cast("string").alias(key)), key, phi)
    small = spark.createDataFrame([(x,) for x in names], "qs_key string").select(F.col("qs_key").cast(schema).alias(key))
    cols = [e.alias(n) for n, e in aggs.items()]
    heavy = tagged.join(_few(small, len(names)), key).groupBy(key).agg(*cols)
    light = tagged.join(_few(small, len(names)), key, "left_anti").groupBy(key).agg(*cols)
    return heavy.unionByName(light)
