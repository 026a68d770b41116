"""Evaluation texts that leak into training text.

Words become a template: words that many test items share stay, numbers, names and units become typed placeholders.
Windows of ten template words are hash-joined between the test set and the corpus. The slots of a re-parameterised leak
must map one to one onto those of the test item: they do if and only if words recur at the same places of both windows,
so the places of recurrence are part of the join, and windows with inconsistent slots never meet. A window with the very
words of the item is an exact leak; its words are part of that join.
A window with too few template words keeps its ordinary words: only numbers, units and identifiers become placeholders
there, then only numbers and units. One with too few words left even so is joined by its very words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.session import materialize

#: Words of a window, and template words (or else ordinary words) that one needs to be joined with placeholders.
WIDTH, LEAST_TEMPLATE = 10, 4
#: Share of test items (and their least number) that must have a word for it to belong to the template.
TEMPLATE_SHARE, TEMPLATE_ITEMS = 0.05, 3
#: Bound for sending the test set's window keys to every task; beyond it the corpus windows are joined by a shuffle without
#: that filter. Template words need no bound: as each belongs to TEMPLATE_SHARE of the items, they are at most
#: 1 / TEMPLATE_SHARE times the mean number of different words of an item, however many items there are.
MAX_KEYS = 4_000_000
#: Units of measurement that are one kind of slot.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years b kb mb gb tb bytes percent pct px mm cm m km g kg t usd eur".split())
#: Most words whose codes a worker keeps.
KEEP = 300_000

_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"[0-9][0-9_]*(?:e[0-9]+)?\Z")
_IDENTIFIER = re.compile(r"\w*[_0-9]\w*\Z")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LITERAL, _TYPED, _NUMBERS = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)


@lru_cache(maxsize=1)
def _format_characters() -> dict[int, None]:
    return {i: None for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf"}


def words_of(text: str) -> list[str]:
    """Words in lower case, format characters (Cf) dropped before."""
    if not text.isascii():
        text = text.translate(_format_characters())
    return _WORD.findall(text.lower())


class Templates:
    """Codes of words: exact ones and those of the typed placeholder that stands for the word."""

    def __init__(self, template: frozenset[str]):
        self.template = template
        self.known: dict[str, tuple[int, int, int, int, int, int, int]] = {}

    def kind(self, w: str) -> str:
        """The word itself if it belongs to the template, else its placeholder."""
        if w in self.template:
            return w
        return "<number>" if _NUMBER.match(w) else "<unit>" if w in UNITS else "<name>"

    def typed(self, w: str, identifiers: bool) -> str:
        """The word itself if it is an ordinary one, else the placeholder of its type."""
        return "<number>" if _NUMBER.match(w) else "<unit>" if w in UNITS else "<identifier>" if identifiers and _IDENTIFIER.match(w) else w

    def code(self, w: str) -> tuple[int, int, int, int, int, int, int]:
        """Codes of the word: exact, in the template, typed, typed but for identifiers; and 1 if it stays in each of the last three."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= KEEP:
                self.known.clear()
            h = xxhash.xxh3_64_intdigest
            forms = self.kind(w), w if w in self.template else self.typed(w, True), w if w in self.template else self.typed(w, False)
            got = self.known[w] = (h(w), *(h(x) for x in forms), int(w in self.template), int(forms[1] == w), int(forms[2] == w))
        return got

    def keys(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The key of each window of each text: (number of the text, place of the window, key)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum())
        if n < WIDTH:
            e = np.zeros(0, np.int64)
            return e, e, np.zeros(0, np.uint64)
        code = self.code
        flat = np.array([code(w) for t in texts for w in t], np.uint64)
        m = n - WIDTH + 1
        # by their template, else with typed placeholders, else with those of numbers and units; windows whose words are
        # equal, or equal but for placeholders, have the same way as they have the same words left
        key = np.zeros(m, np.uint64)
        left = np.ones(m, bool)
        for form, stays, salt in ((1, 4, np.uint64(0)), (2, 5, _TYPED), (3, 6, _NUMBERS), (0, None, _LITERAL)):
            total = None if stays is None else np.concatenate([[0], np.cumsum(flat[:, stays].astype(np.int64))])
            at = np.nonzero(left if total is None else left & (total[WIDTH:] - total[:m] >= LEAST_TEMPLATE))[0]
            h = np.zeros(len(at), np.uint64)
            for k in range(WIDTH if len(at) else 0):
                h = h * _BASE + flat[at + k, form]
            key[at] = h ^ salt
            left[at] = False
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ok = place[:m] + WIDTH <= sizes[text[:m]]
        return text[:m][ok], place[:m][ok], key[ok]


def recurrence(windows: list[list[str]]) -> list[int]:
    """A hash of the places at which each window repeats a word: equal if and only if slots map one to one."""
    out = []
    for w in windows:
        first = {x: i for i, x in reversed(list(enumerate(w)))}
        out.append(0 if len(first) == len(w) else xxhash.xxh3_64_intdigest(bytes(first[x] for x in w)) >> 1)
    return out


WINDOWS = "row_id long, field string, pos long, key long, slots long, words array<string>"


def windows(df: DataFrame, id_col: str, fields: list[str], template: frozenset[str], only: np.ndarray | None) -> DataFrame:
    """The windows of every text of `df` (WINDOWS), in one pass; with `only`, those whose key is among them.

    Null, blank and short texts have none. Long texts are cut nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(template)
        for b in batches:
            ids = b.column(0).to_pylist()
            for n, field in enumerate(fields, 1):
                texts = [words_of(x) if x else [] for x in b.column(n).to_pylist()]
                text, place, key = t.keys(texts)
                if only is not None and len(key):
                    at = np.minimum(np.searchsorted(only, key), len(only) - 1) if len(only) else np.zeros(len(key), np.int64)
                    hit = only[at] == key if len(only) else np.zeros(len(key), bool)
                    text, place, key = text[hit], place[hit], key[hit]
                rows = pa.array([ids[i] for i in text], pa.int64())
                words = [texts[i][p : p + WIDTH] for i, p in zip(text, place)]
                yield pa.record_batch(
                    [rows, pa.array([field] * len(text), pa.string()), pa.array(place, pa.int64()), pa.array(key.view(np.int64)), pa.array(recurrence(words), pa.int64()), pa.array(words, pa.list_(pa.string()))],
                    names=["row_id", "field", "pos", "key", "slots", "words"],
                )

    return df.select(F.col(id_col).cast("long").alias("row_id"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(fields))).mapInArrow(run, WINDOWS)


def template_words(items: DataFrame, id_col: str, fields: list[str]) -> frozenset[str]:
    """The words that make up the template of the test set."""
    n = items.select(id_col).distinct().count()

    def run(batches):
        for b in batches:
            ids, out_i, out_w = b.column(0).to_pylist(), [], []
            for k in range(len(fields)):
                for i, x in zip(ids, b.column(k + 1).to_pylist()):
                    w = {w for w in words_of(x or "") if not _NUMBER.match(w)}
                    out_i += [i] * len(w)
                    out_w += w
            yield pa.record_batch([pa.array(out_i, pa.int64()), pa.array(out_w, pa.string())], names=["i", "w"])

    found = items.select(F.col(id_col).cast("long").alias("i"), *fields).mapInArrow(run, "i long, w string").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    least = max(TEMPLATE_ITEMS, TEMPLATE_SHARE * n)
    return frozenset(r.w for r in found.filter(F.col("n") >= least).collect())


def matches(spark: SparkSession, corpora: list[tuple[str, DataFrame, str, str]], items: DataFrame, item_id: str, item_fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(windows of the corpora whose key is one of the test set's: corpus, row_id, pos, key, slots, words) and (those of
    the test set: item_id, key, slots, words; each once).

    corpora: (name, table, id column, text column). An item whose field is null or shorter than a window can't be
    found by that field. Repeated rows and windows repeat. The test set may be of any size; only its size decides
    whether its keys are sent to the tasks.
    """
    template = template_words(items, item_id, item_fields)
    test = materialize(windows(items, item_id, item_fields, template, None).select(F.col("row_id").alias("item_id"), "key", "slots", "words").distinct(), "p3")
    keys = test.select("key").distinct()
    only = np.sort(keys.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)) if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS else None
    parts = [windows(df, i, [t], template, only).select(F.lit(name).alias("corpus"), "row_id", "pos", "key", "slots", "words") for name, df, i, t in corpora]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found, test


def _hashed(w: DataFrame) -> DataFrame:
    return w.withColumn("h", F.xxhash64("words"))


def exact_leaks(found: DataFrame, test: DataFrame) -> DataFrame:
    """(corpus, row_id, item_id) of records that share a window's very words with an item.

    Equal words have equal templates and slots, so the join takes the words into its key: nothing else comes out of it.
    Windows that a record has more than once, or many items share, meet once.
    """
    mine = _hashed(found).select("corpus", "row_id", "key", "h", "words")
    hits = mine.join(_hashed(test).select("key", "h", F.col("words").alias("item_words"), "item_id"), ["key", "h"]).filter(F.col("words") == F.col("item_words"))
    return hits.select("corpus", "row_id", "item_id").distinct()


def template_leaks(found: DataFrame, test: DataFrame) -> DataFrame:
    """Leaks of either kind: (corpus, row_id, item_id, exact, n_windows, n_items).

    A window counts for every item whose slots it fits, as those of one template can't be told apart. exact: some window
    has the very words of the item; n_items is the largest number of items that one of the windows fits. Windows of one
    record and template are counted before they meet the items, which are classes of (key, slots).
    """
    fits = test.select("key", "slots", "item_id").distinct()
    classes = materialize(fits.groupBy("key", "slots").agg(F.count(F.lit(1)).alias("n_items")), "p3c")
    mine = materialize(found.join(classes, ["key", "slots"]), "p3w")
    counted = mine.groupBy("corpus", "row_id", "key", "slots").agg(F.countDistinct("pos").alias("n_windows"), F.max("n_items").alias("n_items"))
    none = F.lit(0).cast("long")
    all_ = counted.join(fits, ["key", "slots"]).select("corpus", "row_id", "item_id", F.lit(False).alias("exact"), "n_windows", "n_items")
    exact = exact_leaks(mine, test).select("corpus", "row_id", "item_id", F.lit(True).alias("exact"), none.alias("n_windows"), none.alias("n_items"))
    both = all_.unionByName(exact).groupBy("corpus", "row_id", "item_id")
    return both.agg(F.bool_or("exact").alias("exact"), F.sum("n_windows").alias("n_windows"), F.max("n_items").alias("n_items"))
