"""Tolerant comparison of frames: names, types and the order of rows and columns don't count, numbers within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _plain(df: DataFrame, digits: int) -> DataFrame:
    """Columns as text in a canonical form, named by place in the order of their contents' checksums."""
    cols = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
            x = F.when(F.isnan(x.cast("double")), None).otherwise(F.round(x.cast("double"), digits) + 0.0)
        elif t in ("date", "timestamp", "timestamp_ntz"):
            x = x.cast("timestamp")
        cols.append(F.coalesce(x.cast("string"), F.lit("\0")).alias(f"c{len(cols)}"))
    plain = df.select(*cols)
    sums = plain.agg(*[F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(c) for c in plain.columns]).first() if plain.columns else []
    order = sorted(range(len(plain.columns)), key=lambda i: (str(sums[i]), i))
    return plain.select(*[F.col(f"c{i}").alias(f"x{n}") for n, i in enumerate(order)])


def same(a: DataFrame, b: DataFrame, digits: int = 6) -> bool:
    """Whether both hold the same rows, however named, typed, ordered; numbers equal to `digits` decimals."""
    if len(a.columns) != len(b.columns):
        return False
    x, y = _plain(a, digits), _plain(b, digits)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, column_name, left_value, right_value) of cells that differ between rows of equal key; nulls are equal."""
    cols = [c for c in a.columns if c not in key and c in b.columns]
    j = a.select(*key, *[F.col(c).cast("string").alias(f"l_{c}") for c in cols]).join(b.select(*key, *[F.col(c).cast("string").alias(f"r_{c}") for c in cols]), key)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value")) for c in cols])
    return j.select(*key, F.explode(cells).alias("x")).select(*key, "x.*").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
