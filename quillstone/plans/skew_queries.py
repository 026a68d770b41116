"""Queries of problem 2 (a few keys holding most records) over preprocessed_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.operators import skew
from quillstone.session import materialize
from quillstone.sources.tables import table

#: Share of all records from which a key counts as heavy.
PHI = 0.02


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Each record once: (template, owner, support), both keys null where there is none."""
    one = skew.once(table(spark, d, "preprocessed_items", "item_id", "key", "template", "support"), "item_id")
    template = skew.strip(F.col("template"))
    return one.select(
        F.when(template != "", template).alias("template"),
        F.lower(F.substring_index("key", "/", 1)).alias("owner"),
        "support",
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    items = materialize(_items(spark, d), "p2")
    parts = [skew.heavy_keys(items, c, PHI).select(F.lit(c).alias("key_kind"), F.col(c).alias("key_value")) for c in ("template", "owner")]
    return parts[0].unionByName(parts[1])


def template_support(spark: SparkSession, d: str) -> DataFrame:
    """Support and number of records of each template (null support counts as 0)."""
    items = materialize(_items(spark, d).select("template", "support"), "p2")
    total = F.coalesce(F.sum(F.col("support").cast("decimal(20,0)")), F.lit(0)).cast("double")
    return skew.aggregate_skewed(items, "template", {"support": total, "n_records": F.count(F.lit(1))})


def owner_records(spark: SparkSession, d: str) -> DataFrame:
    """Number of records of each owner."""
    items = materialize(_items(spark, d).select("owner"), "p2")
    return skew.aggregate_skewed(items, "owner", {"n_records": F.count(F.lit(1))})


QUERIES = {"p2_found": found, "p2_template_support": template_support, "p2_owner_records": owner_records}

_ONE = r"""WITH one AS (SELECT item_id, any_value("key") k, any_value(template) t, any_value(support) s FROM preprocessed_items GROUP BY item_id),
items AS (SELECT nullif(regexp_replace(t, '^\s+|\s+$', '', 'g'), '') AS template, lower(split_part(k, '/', 1)) AS owner, s AS support FROM one)
"""

ORACLE = {
    "p2_found": _ONE
    + """SELECT 'template' AS key_kind, template AS key_value FROM items WHERE template IS NOT NULL GROUP BY template HAVING count(*) >= 0.02 * (SELECT count(*) FROM items)
UNION ALL SELECT 'owner', owner FROM items WHERE owner IS NOT NULL GROUP BY owner HAVING count(*) >= 0.02 * (SELECT count(*) FROM items)""",
    "p2_template_support": _ONE + "SELECT template, CAST(coalesce(sum(support), 0) AS DOUBLE) AS support, count(*) AS n_records FROM items WHERE template IS NOT NULL GROUP BY template",
    "p2_owner_records": _ONE + "SELECT owner, count(*) AS n_records FROM items WHERE owner IS NOT NULL GROUP BY owner",
}
