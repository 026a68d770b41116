import random

import pytest

from quillstone.llm import languages, leaks
from quillstone.llm.queries import QUERIES


def _save(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{d}/{name}.parquet")


TEXT = "accumulate the polar jetty values per harvest and keep only 21 dusky rows whose delta stays above 872 before"


def _leak_tables(spark, d, docs, codes, items):
    _save(spark, d, "documents", [(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    _save(spark, d, "autodoc_results", [(i, t, "x") for i, t in codes], "rec_id long, code string, words string")
    _save(spark, d, "inspection_items", items, "item_id long, intent string, ground_truth string, key string")


def test_leaks(spark, tmp_path):
    w = TEXT.split()
    items = [(1, TEXT, None, None), (2, TEXT.replace("polar jetty", "amber gate").replace("21", "33"), "", None), (3, TEXT.replace("harvest", "crop"), "too short", None), (4, None, "df.f(a_b, c_d).g(e_f)[0] + h_i * j_k - l_m / n_o", None)]
    docs = [
        (1, "x " + " ".join(w[:10])), (2, " ".join(w[:9])), (3, "see\n> " + "\n> ".join(w[3:14]).upper()), (4, None), (5, ""), (6, "po­lar".join(TEXT.split("polar"))),
        (7, TEXT.replace("polar jetty", "icy barge").replace("21", "99").replace("872", "5")), (8, "word " * 60_000 + TEXT), (None, TEXT), (1, "x " + " ".join(w[:10])),
    ]
    codes = [(1, "y = DF.F(A_B, C_D).G(E_F)[0] + H_I*J_K - L_M/N_O"), (2, "  "), (3, "# " + TEXT)]
    _leak_tables(spark, tmp_path, docs, codes, items)
    rows = QUERIES["p3_found"](spark, str(tmp_path)).collect()
    got = {tuple(r) for r in rows}
    ten = {k: leaks.words_of(v or "") for k, v in [(("documents", i), t) for i, t in docs] + [(("autodoc_results", i), t) for i, t in codes]}
    want = set()
    for (c, i), ws in ten.items():
        grams = {tuple(ws[k : k + 10]) for k in range(len(ws) - 9)}
        for it, a, b, _ in items:
            for f in (a, b):
                fw = leaks.words_of(f or "")
                if grams & {tuple(fw[k : k + 10]) for k in range(len(fw) - 9)}:
                    want.add((c, i, it))
    assert got == want and len(rows) == len(got) and ("documents", 6, 1) in got and ("autodoc_results", 1, 4) in got
    again = [r for r in QUERIES["p3_templates"](spark, str(tmp_path)).collect() if r.row_id == 7]
    assert again and not any(r.exact for r in again)  # the re-parameterised one


def test_every_item_of_a_template_is_named(spark, tmp_path):
    """Each document's windows fit all three items of one template; one document has the very words of the second."""
    items = [(i, TEXT.replace("polar jetty", x).replace("21", str(i)), None, None) for i, x in ((1, "polar jetty"), (2, "amber gate"), (3, "icy barge"))]
    docs = [(1, TEXT.replace("polar jetty", "red door").replace("21", "99")), (2, items[1][1])]
    _leak_tables(spark, tmp_path, docs, [], items)
    got = {(r.row_id, r.item_id): (r.exact, r.n_items) for r in QUERIES["p3_templates"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): (False, 3), (1, 2): (False, 3), (1, 3): (False, 3), (2, 1): (False, 3), (2, 2): (True, 3), (2, 3): (False, 3)}


def test_wording_of_its_own_is_caught_with_another_number(spark, tmp_path):
    """No word of the items is a template word; a changed number, unit or identifier joins all the same, a changed word doesn't."""
    own = "drop sensor readings above 40 seconds from col_a whenever voltage"
    code = "x.f_1 g_2 h_3 i_4 j_5 7 k_6 l_7 m_8"
    docs = [(1, own.replace("40", "55")), (2, own.replace("seconds", "hours").replace("col_a", "col_b")), (3, own.replace("voltage", "pressure")), (4, own), (5, code.replace(" 7 ", " 9 "))]
    _leak_tables(spark, tmp_path, docs, [], [(1, own, None, None), (2, None, code, None)])
    got = {(r.row_id, r.item_id, r.exact) for r in QUERIES["p3_templates"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, False), (2, 1, False), (4, 1, True), (5, 2, False)}
    assert [tuple(r) for r in QUERIES["p3_found"](spark, str(tmp_path)).collect()] == [("documents", 4, 1)]


def test_windows_with_inconsistent_slots_never_meet(spark, tmp_path):
    """One template key, but names that recur at other places: no row of the join, whatever the words."""
    items = [(i, TEXT.replace("polar jetty", x), None, None) for i, x in ((1, "polar jetty"), (2, "amber amber"), (3, "icy barge"))]
    docs = [(1, TEXT.replace("polar jetty", "red red")), (2, TEXT.replace("polar jetty", "red door"))]
    _leak_tables(spark, tmp_path, docs, [], items)
    n = {(r.row_id, r.item_id): r.n_windows for r in QUERIES["p3_templates"](spark, str(tmp_path)).collect()}
    assert n[1, 2] - n[1, 1] == n[2, 1] - n[2, 2] == 3 and n[1, 1] == n[1, 3] and n[2, 1] == n[2, 3]  # three windows hold the names
    a, b, c, d = leaks.recurrence([["a", "b", "a"], ["x", "y", "x"], ["x", "y", "y"], ["a", "b", "c"]])
    assert a == b != c and d == 0


def test_leaks_without_key_filter(spark, tmp_path, monkeypatch):
    _leak_tables(spark, tmp_path, [(1, TEXT)], [], [(1, TEXT, TEXT, None)])
    monkeypatch.setattr(leaks, "MAX_KEYS", 0)
    assert [tuple(r) for r in QUERIES["p3_found"](spark, str(tmp_path)).collect()] == [("documents", 1, 1)]


def test_leaks_empty(spark, tmp_path):
    _leak_tables(spark, tmp_path, [], [], [])
    assert QUERIES["p3_found"](spark, str(tmp_path)).collect() == []


SAMPLES = {
    "en": "The table was sorted by date before we removed the rows that were empty. This makes the average easier to read.",
    "de": "Die Tabelle wurde nach dem Datum sortiert, bevor wir die leeren Zeilen entfernten. So ist der Mittelwert leichter zu lesen.",
    "fr": "Le tableau a été trié par date avant que nous supprimions les lignes vides. Cela rend la moyenne plus facile à lire.",
    "es": "La tabla se ordenó por fecha antes de que quitáramos las filas vacías. Así el promedio es más fácil de leer.",
    "pt": "A tabela foi ordenada pela data antes de removermos as linhas vazias. Assim a média fica mais fácil de ler.",
    "it": "La tabella è stata ordinata per data prima di togliere le righe vuote. Così la media è più facile da leggere.",
    "nl": "De tabel werd op datum gesorteerd voordat we de lege rijen verwijderden. Zo is het gemiddelde makkelijker te lezen.",
    "ru": "Таблица была отсортирована по дате, прежде чем мы удалили пустые строки. Так среднее значение легче читать.",
}


@pytest.fixture(scope="module")
def profiles():
    return languages.Profiles(languages.fit([]))


@pytest.mark.parametrize("lang", languages.LANGS)
def test_function_words_alone_identify(profiles, lang):
    assert [x for x, _, _ in languages.analyse(SAMPLES[lang], profiles)] == [lang]


def test_bundle_products_distribute(profiles):
    import numpy as np

    words = "the rows of a table".split()
    total = sum(languages.word_vector(w)[0].astype(float) for w in words)
    assert np.allclose(profiles.score(words) * np.sqrt(languages.DIM * sum(languages.word_vector(w)[1] for w in words)), profiles.prototypes @ total, rtol=1e-3, atol=1e-2)


def test_segments(profiles):
    mixed = SAMPLES["en"] + "\n```python\nfor x in rows: pass\n```\n" + SAMPLES["de"] + " " + SAMPLES["en"]
    assert [x for x, _, _ in languages.analyse(mixed, profiles)] == ["en", "de", "en"]
    inside = SAMPLES["en"] + " The file (so ist das Leben eben) arrives every night and is read."
    assert [x for x, _, _ in languages.analyse(inside, profiles)] == ["en"]


def test_wrong_labels(spark, profiles):
    rows = [(1, SAMPLES["de"], "en"), (2, SAMPLES["fr"], "FR-ca"), (3, SAMPLES["it"], None), (4, SAMPLES["en"] + " " + SAMPLES["ru"], "en"), (5, None, "en"), (6, "", None), (7, " \n--", ""), (8, SAMPLES["nl"] * 3000, "nld"), (9, SAMPLES["pt"], "xx"), (9, SAMPLES["pt"], "xx")]
    df = spark.createDataFrame([(a, b, c, "k") for a, b, c in rows], "doc_id long, text string, lang string, seg_no string")
    found = languages.wrong_labels(languages.identify(df, languages.fit([]))).collect()
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in found) == [(1, 0, "de"), (3, 0, "it"), (4, 0, "en"), (4, 1, "ru"), (9, 0, "pt"), (9, 0, "pt")]
    assert all(0 <= r.confidence <= 1 for r in found)
    assert languages.identify(df.limit(0), languages.fit([])).collect() == []


def test_held_out_accuracy(spark):
    """Sentences made of shuffled words of each language; labels of the sample a fifth wrong."""
    r = random.Random(3)
    vocabulary = {k: (languages.FUNCTION_WORDS[k] + " " + v.replace(".", "").replace(",", "").lower()).split() for k, v in SAMPLES.items()}
    made = [(k, " ".join(r.choices(v, k=14)).capitalize() + ".") for k, v in vocabulary.items() for _ in range(60)]
    train = [(r.choice(languages.LANGS) if r.random() < 0.2 else k, s) for k, s in made[::2]]
    p = languages.Profiles(languages.fit(train))
    held = made[1::2]
    assert sum(languages.analyse(s, p)[0][0] == k for k, s in held) >= 0.97 * len(held)


def test_long_words_count_whole():
    import numpy as np

    head = "x" * 70
    a, n = languages.word_vector(head + "sortiert")
    b, m = languages.word_vector(head)
    assert n > m and not np.array_equal(a, b)
    v, n = languages.word_vector("qwertz" * 20_000)
    assert n == 240_000 and v.shape == (languages.DIM,)
