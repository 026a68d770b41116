"""Queries over stores and files: what was written to the shared folder is read back and compared with its source."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.operators import descriptions
from quillstone.session import remove, scratch_dir
from quillstone.sources import store as st
from quillstone.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder, which is removed when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0")
def keyed_store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Half of the records inserted, the missing ones added, a lookup by a table of keys."""
    s = table(spark, d, "supplier", "s_suppkey", "s_acctbal")
    keyed = st.KeyedStore(spark, _path(spark, "keyed"), "s_suppkey", "s_suppkey long, s_acctbal double")
    keyed.insert(s.filter("s_suppkey % 2 = 0"))
    keyed.insert_missing(s)
    return keyed.lookup(s.filter("s_suppkey % 3 = 0").select("s_suppkey")).select("s_suppkey", "s_acctbal")


@query("SELECT CAST(p AS BIGINT) AS ord, name FROM (SELECT r_name AS name, row_number() OVER (ORDER BY r_name) - 1 AS p FROM region UNION ALL SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 + (SELECT count(*) FROM region) FROM nation) WHERE p IN (0, 3, 5, 20)")
def ordered_list_reads(spark: SparkSession, d: str) -> DataFrame:
    """A4: two appends, reads by place."""
    kept = st.OrderedList(spark, _path(spark, "ordered"), "name string")
    kept.append(table(spark, d, "region").select(F.col("r_name").alias("name")), ["name"])
    kept.append(table(spark, d, "nation").select(F.col("n_name").alias("name")), ["name"])
    return kept.at([0, 3, 5, 20]).select("ord", "name")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A8, read_csv, read_table, to_csv: tab-separated with a declared schema; only the columns used are read."""
    path = _path(spark, "csv")
    table(spark, d, "part").write.option("header", True).option("sep", "\t").csv(path)
    return st.read_csv(spark, path, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", ["p_partkey", "p_brand", "p_retailprice"], "\t")


@query("SELECT 'json' AS kind, event_id, value FROM events UNION ALL SELECT 'orc', event_id, value FROM events UNION ALL SELECT 'parquet', event_id, value FROM events UNION ALL SELECT 'xml', event_id, value FROM events")
def file_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """to_json, read_json, read_orc, to_parquet, read_parquet, to_xml; the Parquet files in folders by type."""
    e = table(spark, d, "events", "event_id", "event_type", "value")
    out = None
    for kind in ("json", "orc", "parquet", "xml"):
        path = _path(spark, kind)
        w = e.write.format(kind).option("rowTag", "event")
        (w.partitionBy("event_type") if kind == "parquet" else w).save(path)
        x = spark.read.format(kind).schema("event_id long, event_type string, value double").option("rowTag", "event").load(path).select(F.lit(kind).alias("kind"), "event_id", "value")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def fixed_width_lines(spark: SparkSession, d: str) -> DataFrame:
    """read_fwf."""
    path = _path(spark, "fwf")
    table(spark, d, "nation").select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 6, " "), F.rpad("n_name", 30, " "))).write.text(path)
    return st.read_fixed_width(spark, path, {"k": (0, 6), "name": (6, 36)}).select(F.col("k").cast("int").alias("k"), "name")


@query("SELECT item_id, description, true AS is_derived FROM (VALUES (2, 'Keep rows with age above 40.'), (4, 'Show the first 7 rows.'), (6, 'Keep rows with cost above 9.')) t(item_id, description)")
def transferred_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """A37, E10 on written rows: descriptions handed on within a template; items that do not unify get none."""
    rows = [
        (1, "df[df[STR1] > INT1]", "df[df['price'] > 30]", "Keep rows with price above 30."), (2, "df[df[STR1] > INT1]", "df[df['age'] > 40]", None), (3, "df.head(INT1)", "df.head(5)", "Show the first 5 rows."),
        (4, "df.head(INT1)", "df.head(7)", None), (5, "df.head(INT1)", "df.tail(7)", None), (6, "df[df[STR1] > INT1]", "df[df['cost'] > 9]", None), (7, "df.sum()", "df.sum()", None),
    ]
    items = spark.createDataFrame(rows, "item_id int, template string, code string, description string")
    return descriptions.transfer(items.filter("description is not null"), items.drop("description"))
