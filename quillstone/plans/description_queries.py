"""Queries of the description dataflow and of mining over the stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.operators import descriptions, mining
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


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "autodoc_results", "rec_id", "canonical_descs").dropDuplicates(["rec_id"])
    return r.select("rec_id", F.posexplode("canonical_descs").alias("pos", "c")).select("rec_id", "pos", F.col("c.nl_desc.primary_desc").alias("text"), F.col("c.equivalent").alias("equivalent"), F.col("c.parameterized").alias("parameterized"), F.col("c.assistance_level").alias("level"))


_CANONICAL = """WITH r AS (SELECT rec_id, any_value(canonical_descs) AS c FROM autodoc_results GROUP BY rec_id), x AS (SELECT rec_id, i - 1 AS pos, c[i].nl_desc.primary_desc AS text, c[i].equivalent AS equivalent, c[i].parameterized AS parameterized, c[i].assistance_level AS level
FROM r, LATERAL (SELECT unnest(generate_series(1, len(c))) AS i)) """


@query(_CANONICAL + "SELECT rec_id, count(text) FILTER (coalesce(equivalent AND parameterized, false)) AS n_success, count(text) FILTER (NOT coalesce(equivalent AND parameterized, false)) AS n_failed FROM x GROUP BY 1")
def description_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = descriptions.outcomes(_canonical(spark, d), "rec_id", "text", F.col("equivalent") & F.col("parameterized"))
    return o.select("rec_id", F.size("success").cast("long").alias("n_success"), F.size("failed").cast("long").alias("n_failed"))


@query(_CANONICAL + "SELECT rec_id, min(level) AS level FROM x WHERE equivalent GROUP BY 1")
def least_assistance(spark: SparkSession, d: str) -> DataFrame:
    return descriptions.least_level(_canonical(spark, d), ["rec_id"], "level", "equivalent")


@query(_CANONICAL + "SELECT rec_id, pos, CASE WHEN coalesce(equivalent AND parameterized, false) THEN 'strict' ELSE 'lenient' END AS mode FROM x WHERE coalesce(equivalent, false) QUALIFY coalesce(equivalent AND parameterized, false) OR max(coalesce(equivalent AND parameterized, false)::INT) OVER (PARTITION BY rec_id) = 0")
def strict_then_lenient(spark: SparkSession, d: str) -> DataFrame:
    x = descriptions.strict_then_lenient(_canonical(spark, d), "rec_id", F.col("equivalent") & F.col("parameterized"), F.col("equivalent"))
    return x.select("rec_id", F.col("pos").cast("long").alias("pos"), "mode")


@query(_CANONICAL + r"SELECT rec_id, min(pos) AS pos FROM x WHERE text IS NOT NULL GROUP BY rec_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')))")
def diverse_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return descriptions.diverse(_canonical(spark, d).filter("text is not null"), "rec_id", "text", "pos").select("rec_id", F.col("pos").cast("long").alias("pos"))


@query("""SELECT intent, min(item_id) AS item_id FROM (SELECT item_id, unnest([intent, replace(intent, '''', '"'), regexp_replace(intent, '[''"`]', '', 'g')]) AS intent FROM inspection_items) WHERE intent IS NOT NULL GROUP BY 1""")
def quote_variants(spark: SparkSession, d: str) -> DataFrame:
    return descriptions.quote_variants(table(spark, d, "inspection_items", "item_id", "intent"), "item_id", "intent").select("intent", "item_id")


@query(_CANONICAL + "SELECT rec_id, bool_or(equivalent) AS solved FROM x GROUP BY 1")
def solved_records(spark: SparkSession, d: str) -> DataFrame:
    return descriptions.solved(_canonical(spark, d), "rec_id", "equivalent")


@query()
def description_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of successful records handed on to other records of their template."""
    r = table(spark, d, "autodoc_results", "rec_id", "code", "template", "success", "canonical_descs").dropDuplicates(["rec_id"]).filter("template is not null and code is not null")
    text = F.get("canonical_descs.nl_desc.primary_desc", F.lit(0))
    done = r.filter(F.col("success") & text.isNotNull()).select(F.col("rec_id").alias("item_id"), "template", "code", text.alias("description"))
    return descriptions.transfer(done, r.select(F.col("rec_id").alias("item_id"), "template", "code"))


@query()
def few_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "autodoc_results", "rec_id", "code", "source", "canonical_descs").dropDuplicates(["rec_id"]).filter("code is not null")
    text = F.get("canonical_descs.nl_desc.primary_desc", F.lit(0))
    examples = r.filter(text.isNotNull()).select(F.col("source").alias("kind"), "code", text.alias("text"), "rec_id")
    return descriptions.prompts(r.select(F.col("rec_id").alias("task_id"), "code", F.col("source").alias("kind")), examples, "rec_id", "Describe the code.")


@query()
def embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    return descriptions.embedding_pairs(table(spark, d, "embeddings", "vec_id", "label"), "label", "vec_id", 3, 2)


@query()
def mined_snippets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "autodoc_results", "rec_id", "code").dropDuplicates(["rec_id"]).filter("code is not null")
    return mining.mine(c, "rec_id", "code")


@query("""SELECT task_id, json_extract_string(j, '$.metadata.kernelspec.name') AS kernel, coalesce(json_array_length(j, '$.cells'), 0)::INT AS n_cells FROM (SELECT task_id, any_value(nb_json) AS t FROM mining_tasks GROUP BY 1), LATERAL (SELECT CASE WHEN json_valid(t) THEN t::JSON END AS j) WHERE json_valid(t) AND json_type(j) = 'OBJECT' AND coalesce(json_array_length(j, '$.cells'), 0) > 0""")
def notebook_facts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mining_tasks", "task_id", "nb_json").dropDuplicates(["task_id"])
    # only what is an object has facts; whether it is one is told by the variant reader
    ok = t.filter(F.expr("schema_of_variant(try_parse_json(nb_json)) like 'OBJECT%'"))
    return mining.notebook_facts(ok, "nb_json").select("task_id", "kernel", "n_cells").filter("n_cells > 0")
