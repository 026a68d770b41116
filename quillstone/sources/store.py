"""Keyed and ordered stores on Parquet, full-text sinks and readers of flat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


class KeyedStore:
    """An insert-only table with unique keys."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def read(self) -> DataFrame:
        """All records; an empty frame where nothing has been written."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def insert(self, df: DataFrame) -> None:
        """Append records; a key that exists or comes twice raises and nothing is written."""
        twice = df.groupBy(self.key).count().filter("count > 1")
        if not twice.isEmpty() or not df.join(self.read().select(self.key), self.key, "left_semi").isEmpty():
            raise KeyError(f"repeated values of {self.key}")
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(self.path)

    def insert_missing(self, df: DataFrame) -> None:
        """Append the records whose keys are not there yet, one per key."""
        new = df.dropDuplicates([self.key]).join(self.read().select(self.key), self.key, "left_anti")
        new.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(self.path)

    def get(self, keys: list) -> DataFrame:
        return self.read().filter(F.col(self.key).isin(keys))

    def lookup(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select(self.key).distinct(), self.key)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


class OrderedList:
    """Records with their place `ord`, appended in batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.store = KeyedStore(spark, path, "ord", f"ord long, {schema}")

    def append(self, df: DataFrame, order: list[str]) -> None:
        from quillstone.operators.frame import position

        n = self.store.read().agg(F.max("ord")).first()[0]
        start = 0 if n is None else n + 1
        self.store.insert(position(df, order, "ord").withColumn("ord", F.col("ord") + start))

    def at(self, places: list[int]) -> DataFrame:
        return self.store.get(places)

    def read(self) -> DataFrame:
        return self.store.read()


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest state of each key from an append-only log."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), at).alias("r")).select(key, "r.*")


def read_fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns by (start, stop) places of each line, trimmed; blank is null."""
    t = spark.read.text(path)
    return t.select(*[F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("")).alias(c) for c, (a, b) in columns.items()])


def read_csv(spark: SparkSession, path: str, schema: str, use: list[str] | None = None, sep: str = ",", na: str = "") -> DataFrame:
    """CSV with a header and a declared schema; `use` prunes columns at the scan."""
    df = spark.read.option("header", True).option("sep", sep).option("nullValue", na).schema(schema).csv(path)
    return df.select(*use) if use else df


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """A table or query of a database, read in `parts` ranges of a numeric column."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    r = r.option("query", table) if table.lstrip().lower().startswith("select") else r.option("dbtable", table)
    if column and bounds:
        r = r.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns as top-level columns parent<sep>child, to any depth."""
    from pyspark.sql.types import StructType

    while any(isinstance(f.dataType, StructType) for f in df.schema.fields):
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, StructType):
                cols += [F.col(f"`{f.name}`").getField(c.name).alias(f"{f.name}{sep}{c.name}") for c in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def explode_records(df: DataFrame, path: str, meta: list[str]) -> DataFrame:
    """One row per element of the array at `path` with the meta columns beside; an empty array gives no row."""
    x = df.select(*meta, F.explode(path).alias("record"))
    return x.select(*meta, "record.*") if dict(x.dtypes)["record"].startswith("struct") else x
