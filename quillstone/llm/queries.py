"""The queries of problems 1 and 3 to 10 with their SQL, where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.llm import answers, bpe, formats, languages, leaks, mixing, neardup, parse
from quillstone.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_table(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    return mixing.prepare(table(spark, d, "documents", "doc_id", "source", "text"), targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The copies of the mix in order."""
    sized, targets = _sized(spark, d)
    return mixing.fair_mix(sized, targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    sized, targets = _sized(spark, d)
    return mixing.shares(mixing.fair_mix(sized, targets), sized, targets)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(answers.judged(table(spark, d, "autodoc_results"), answers.LISTS[:2]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.cut_values(answers.judged(table(spark, d, "autodoc_results"), answers.LISTS))


def p4_method(spark: SparkSession, d: str) -> DataFrame:
    """The censoring posterior alone, of every value with content."""
    return answers.censoring(answers.judged(table(spark, d, "autodoc_results"), answers.LISTS))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts each field, and at which lengths."""
    return answers.cut_rates(answers.judged(table(spark, d, "autodoc_results"), answers.LISTS))


def _leaks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    corpora = [
        ("documents", table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"),
        ("autodoc_results", table(spark, d, "autodoc_results", "rec_id", "code"), "rec_id", "code"),
    ]
    return leaks.matches(spark, corpora, table(spark, d, "inspection_items", "item_id", "intent", "ground_truth"), "item_id", ["intent", "ground_truth"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.exact_leaks(*_leaks(spark, d))


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    """Leaks word by word and re-parameterised ones, with the number of windows."""
    return leaks.template_leaks(*_leaks(spark, d))


def _checked(spark: SparkSession, d: str, all_rows: bool) -> DataFrame:
    files = parse.check_files(table(spark, d, "mining_tasks"), "mining_tasks", "task_id", "base_uid", "nb_json", "path", all_rows)
    return files.unionByName(parse.check_files(table(spark, d, "autodoc_results"), "autodoc_results", "rec_id", "uid", "code", None, all_rows))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse.once(_checked(spark, d, False)).select("tbl", "row_id")


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of each broken file with the first cause."""
    return parse.once(_checked(spark, d, False))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Broken files per owner and language."""
    return parse.rates(_checked(spark, d, True))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(
        [
            neardup.run_sets(table(spark, d, "autodoc_results", "rec_id", "code"), "autodoc_results", "rec_id", "code"),
            neardup.run_sets(table(spark, d, "mining_tasks", "task_id", "nb_json"), "mining_tasks", "task_id", "nb_json"),
        ]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of(*_near(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every record that is like another."""
    return neardup.groups_of(*_near(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = formats.copy_groups(table(spark, d, "autodoc_results", "rec_id", "code"), "rec_id", "code")
    return members.filter(F.col("rec_id") != F.col("first_id")).select("first_id", F.col("rec_id").alias("copy_id"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group of copies with the size of the group."""
    return formats.copy_groups(table(spark, d, "autodoc_results", "rec_id", "code"), "rec_id", "code")[1]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return languages.identify(docs, languages.fit(languages.labelled_sample(docs, "text", "lang", "doc_id")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_labels(_segments(spark, d)).select("doc_id", "seg_no", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    return _segments(spark, d)


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_templates": p3_templates,
    "p4_method": p4_method,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_errors": p5_errors,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}
#: Words and windows in SQL; the other queries have no SQL form (parsers, models, the tokenizer, hashes).
_WORDS = r"regexp_extract_all(lower(regexp_replace({}, '\p{{Cf}}', '', 'g')), '[\p{{L}}\p{{N}}_]+')"
_WINDOWS = "SELECT DISTINCT {} AS id, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT {}, {} AS w FROM {}), LATERAL (SELECT unnest(generate_series(1, len(w) - 9)) AS i)"


def _windows(key: str, text: str, table_: str) -> str:
    return _WINDOWS.format(key, key, _WORDS.format(text), table_)


def _runs(table_: str, key: str, text: str) -> str:
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format(text)
    return f"SELECT DISTINCT '{table_}' AS tbl, {key} AS id, array_to_string(w[i : i + 2], ' ') AS run FROM (SELECT {key}, {words} AS w FROM {table_}), LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)"


ORACLE: dict[str, str] = {
    "p3_found": f"""WITH t AS ({_windows("item_id", "intent", "inspection_items")} UNION {_windows("item_id", "ground_truth", "inspection_items")}),
c AS (SELECT 'documents' AS corpus, * FROM ({_windows("doc_id", "text", "documents")}) UNION ALL SELECT 'autodoc_results', * FROM ({_windows("rec_id", "code", "autodoc_results")}))
SELECT DISTINCT corpus, c.id AS row_id, t.id AS item_id FROM c JOIN t USING (win)""",
    "p6_found": f"""WITH r AS ({_runs("autodoc_results", "rec_id", "code")} UNION ALL {_runs("mining_tasks", "task_id", "nb_json")}),
n AS (SELECT tbl, id, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT x.tbl, x.id AS row_a, y.id AS row_b, count(*) AS n FROM r x JOIN r y ON x.tbl = y.tbl AND x.run = y.run AND x.id < y.id GROUP BY 1, 2, 3)
SELECT b.tbl, row_a, row_b FROM b JOIN n p ON p.tbl = b.tbl AND p.id = row_a JOIN n q ON q.tbl = b.tbl AND q.id = row_b WHERE b.n * 10 >= 7 * (p.n + q.n - b.n)""",
}
