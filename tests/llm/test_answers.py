import random

import numpy as np
import pytest

from quillstone.llm import answers, endings, languages
from quillstone.llm.queries import QUERIES

SCHEMA = """rec_id long, code string, source string, canonical_descs array<struct<nl_desc:struct<primary_desc:string,context:string>,kind:string>>,
additional_descs array<struct<nl_desc:struct<primary_desc:string,context:string>,kind:string>>, pos int, field string"""
CODE = "df = pd.read_csv('sales_data.csv')\ndf['total_price'] = df['unit_price'] * df['quantity_sold']\nprint(df.head(7))"


@pytest.mark.parametrize("text", [None, "", " \n\t", "​", "—", "...", "``", "N/A", "none", "(TBD)", "`null`", "???", "No description."])
def test_empty(text):
    assert answers.is_empty(text)


@pytest.mark.parametrize("text", ["x", "Nothing else is changed", "None of the rows is kept", "7"])
def test_not_empty(text):
    assert not answers.is_empty(text)


@pytest.mark.parametrize(
    "text",
    [CODE, CODE.upper(), "```python\n" + CODE.replace("'", '"') + "\n```", "Answer: " + CODE.split("\n")[1], "df['total_price']  =  df['unit_price']*df['quantity_sold']", "print(df.head(7))", "# " + CODE.replace("\n", "\n# ")],
)
def test_copy(text):
    assert answers.Copies(CODE).is_copy(text)


@pytest.mark.parametrize("text", ["Multiply `unit_price` by `quantity_sold` and store the product as `total_price`.", "Load `sales_data` and print the first 7 rows of `df`", "total price", "Compute the total_price", ""])
def test_no_copy(text):
    assert not answers.Copies(CODE).is_copy(text) and not answers.Copies(None).is_copy(text)


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I can't help with that.", "As an AI I do not describe code.", "Unfortunately, this is unclear.", "Please provide the full file first.", "We are not able to explain `x` here.", "Could you share the data?", "I’m not able to answer that.",
     "My guidelines do not permit an answer.", "It would not be appropriate for me to comment on this.", "No explanation can be given for such code.", "What would you like me to do with it?", "I need more context to describe this."],
)
def test_refusal(text):
    assert answers.is_refusal(text)


@pytest.mark.parametrize("text", ["Raise an error if the file cannot be read.", "Sorry-looking labels are left alone.", "Replace values that can't be parsed.", "Help text is shown for rows that the parser refuses to read.", "Describe the table and provide a summary.", "Sorry rows by date", "Unfortunately sorted", "We must access each column", "Please provide the data sorted by date", "We cannot see negative values after filtering"])
def test_no_refusal(text):
    assert not answers.is_refusal(text)


def test_foreign():
    p = languages.Profiles(languages.fit([]))
    assert answers.is_foreign("Sortiert die Zeilen nach `a_b` und berechnet den Mittelwert.", p) and answers.is_foreign("Удаляет строки, где значение не найдено.", p)
    assert answers.is_foreign("按日期排序", p) and answers.is_foreign("並べ替え `df`", p) and answers.is_foreign("для этого", p)
    assert not answers.is_foreign("Sort the rows by `a_b` and compute the mean.", p) and not answers.is_foreign("Use it for the café data.", p) and not answers.is_foreign("`x`", p)


def test_states():
    assert [endings.state_of(x) for x in ("Done.", "Done!) ", "Sort the rows...", "Sort the `ro", "(Sort the rows", "Sort the rows", "Cut here [...]", "Use `a.b`.", "...")] == ["stop", "stop", "omitted", "open", "open", "none", "omitted", "stop", "stop"]


def test_censored_fit_recovers_the_distribution():
    r = np.random.default_rng(4)
    x = np.maximum(1, np.round(np.exp(r.normal(5.0, 0.5, 40_000)))).astype(int)
    cut = np.minimum(x, 220)
    v, n = np.unique(cut, return_counts=True)
    mu, sigma = endings.fit_censored(v, n, 220.0)
    assert abs(mu - 5.0) < 0.02 and abs(sigma - 0.5) < 0.02
    found = endings.limits_of(v, n)
    assert [a for a, _ in found] == [220] and found[0][1] > 0.9
    v, n = np.unique(x, return_counts=True)
    assert endings.limits_of(v, n) == [] and endings.limits_of(np.zeros(0, int), np.zeros(0, int)) == []


def test_two_limits_in_one_source():
    r = np.random.default_rng(5)
    x = np.maximum(1, np.round(np.exp(r.normal(5.0, 0.5, 40_000)))).astype(int)
    feed = r.random(len(x)) < 0.3  # one feed cuts earlier
    v, n = np.unique(np.minimum(x, np.where(feed, 150, 400)), return_counts=True)
    found = dict(endings.limits_of(v, n))
    assert set(found) == {150, 400} and found[150] > 0.9 and found[400] > 0.8


def test_one_posterior_for_all_endings(spark):
    from pyspark.sql import functions as F

    rows = [("stop", None), ("stop", 0.9999), ("omitted", None), ("open", None), ("none", None), ("none", 0.99)]
    df = spark.createDataFrame(rows, "state string, p_limit double")
    p = endings.cut_probability(F.col("state"), F.lit(0.3), F.lit(0.05), F.lit(True), F.lit(0.9), F.col("p_limit"), F.lit(False))
    assert [r.p > 0.5 for r in df.select(p.alias("p")).collect()] == [False, False, True, True, False, True]


def test_long_texts_take_little_time():
    import time

    began = time.time()
    for text in (" " * 300_000 + "a", "." * 300_000 + "a", "[" * 100_000 + "x", "n/a" + "-" * 300_000, "​" * 300_000 + "the end"):
        answers.is_empty(text), endings.state_of(text), answers.is_refusal(text[:5_000])
    assert time.time() - began < 20
    assert answers.is_empty("n/a" + "-" * 70) and answers.is_empty("-" * 300_000) and not answers.is_empty("-" * 300 + "sort")


def test_copies_of_any_part_of_a_long_code():
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(260_000)]
    copies = answers.Copies(" ".join(words))
    for at in (0, 130_000, 250_000):
        part = words[at : at + 5_000]
        part[::50] = ["edited"] * len(part[::50])
        assert copies.novelty(" ".join(part)) < 0.1 and copies.is_copy(" ".join(part))
    assert not copies.is_copy(" ".join(f"v{r.randrange(10**6)}" for _ in range(500)))


def _made(n, seed=1):
    """Two sources, one with final stops and a limit of 90, one without stops; some of the second cut at random."""
    r, rows, cut = random.Random(seed), [], set()
    things = ["rows", "columns", "values", "labels", "cells"]
    for i in range(n):
        parts = [f"{r.choice(['sort', 'drop', 'keep', 'count'])} the {r.choice(things)} of `{r.choice('abcd')}_{r.randrange(90)}` {r.choice(['in descending order', 'without any gap', 'by week of the year'])}" for _ in range(r.randint(1, 4))]
        text = ", then ".join(parts).capitalize()
        if i % 2:
            text += "."
            if len(text) > 90:
                text = text[:90]
                if endings.state_of(text) != "stop":
                    cut.add(i)
        elif r.random() < 0.1:
            words = text.split(" ")
            k = r.randrange(3, len(words))
            if words[k - 1].rstrip(",") not in ("order", "gap", "year"):
                text = " ".join(words[:k])
                cut.add(i)
        rows.append((i, CODE, "stops" if i % 2 else "bare", [], [((text, None), "k")], 1, "f"))
    return rows, cut


def test_cut_values(spark, tmp_path):
    rows, cut = _made(3000)
    spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/autodoc_results.parquet")
    got = QUERIES["p4_found"](spark, str(tmp_path)).collect()
    found = {r.rec_id for r in got}
    assert len(got) == len(found) and all(r.pos == 0 and r.field == "primary_desc" for r in got)
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.95 * len(found)
    rate = {r.source: r for r in QUERIES["p4_rates"](spark, str(tmp_path)).collect()}
    assert rate["stops"].limits == [90] and rate["bare"].n_values == 1500
    assert {r.defect for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()} == {"truncated"}


def test_defects_and_edges(spark, tmp_path):
    ok = ("Sort the rows by `a_b` and compute the mean of the values.", None)
    rows = [(i, CODE, "s", [(ok, "k")], [(ok, "k")], 1, "f") for i in range(100, 160)]
    rows += [
        (1, CODE, "s", [(None, "k"), None, (ok, "k")], None, 1, "f"), (2, CODE, None, [], [((CODE, CODE), "k"), (("I can't describe this.", "N/A"), "k")], 1, "f"), (3, None, "s", [(("Sortiert die Zeilen nach dem Datum und entfernt die Spalte.", ""), "k")], [], 1, "f"),
        (4, "", "s", None, [(("Sort the rows by `a_", "The frame `df` holds the col"), "k")], 1, "f"), (5, CODE, "s", None, [(("the word " * 40_000 + "end.", None), "k")], 1, "f"), (2, CODE, None, [], [((CODE, CODE), "k"), (("I can't describe this.", "N/A"), "k")], 1, "f"),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/autodoc_results.parquet")
    got = sorted(tuple(r) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect())
    assert got == [(1, "canonical", 0, "empty"), (1, "canonical", 1, "empty"), (2, "additional", 0, "copy"), (2, "additional", 1, "refusal"), (3, "canonical", 0, "other_language"), (4, "additional", 0, "truncated")]
    assert sorted(tuple(r) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect()) == [(4, 0, "context"), (4, 0, "primary_desc")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/autodoc_results.parquet")
    for q in ("p1_found", "p4_found", "p4_rates"):
        assert QUERIES[q](spark, str(tmp_path)).collect() == []
