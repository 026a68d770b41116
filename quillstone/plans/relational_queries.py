"""Selection, joins, grouping and ranking over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.sources.tables import table


def star_join_rank(spark: SparkSession, d: str) -> DataFrame:
    """Orders of chosen priorities by nation and segment, ranked by revenue."""
    o = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderpriority").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    g = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return g.select("n_name", "c_mktsegment", "n_orders", "revenue")


QUERIES = {"star_join_rank": star_join_rank}
ORACLE = {
    "star_join_rank": """SELECT n_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2"""
}
