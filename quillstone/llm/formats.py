"""Duplicates hidden by formatting differences.

A record's canonical key is the sequence of its words in lower case, with the keyword arguments of each call and the
entries of each dict literal in sorted order. Equal keys are copies. Hot keys are found exactly from partial counts and
aggregated in two levels with a salt; all others take one shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillstone.session import materialize

#: Rows from which a key is hot, at least; it also is where the key has more than one in SHARE of all rows.
HOT, SHARE, SALTS = 20_000, 2_000, 64

_SCAN = re.compile(
    r"(?P<s>'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'(?:[^\\'\n]|\\.)*'|\"(?:[^\\\"\n]|\\.)*\"|‘[^‘’\n]*’|“[^“”\n]*”|#[^\n]*)"
    r"|(?P<w>\w+)|(?P<p>==|[<>!]=|[=:,()\[\]{}])",
    re.S,
)
_WORD = re.compile(r"\w+")
#: Words before a bracket that open no call (in any case of letters, as copies may differ in case).
_NO_CALL = frozenset("and as assert await del elif else except for from if import in is lambda not or raise return while with yield def class".split())


class _Group:
    """An open bracket: its finished arguments and the one in progress."""

    __slots__ = ("kind", "items", "words", "keyword", "colon", "first")

    def __init__(self, kind: str):
        self.kind, self.items = kind, []
        self.start()

    def start(self) -> None:
        self.words: list[str] = []
        self.keyword = self.colon = False
        self.first = 0  # words and brackets before a possible '='

    def finish(self) -> list[str]:
        if self.words:
            self.items.append((self.words, self.keyword, self.colon))
        items = self.items
        if self.kind == "call":
            at = [i for i, x in enumerate(items) if x[1]]
            if len(at) > 1:
                for i, x in zip(at, sorted(items[i] for i in at)):
                    items[i] = x
        elif self.kind == "{" and len(items) > 1 and all(x[2] for x in items):
            items.sort()
        out: list[str] = []
        for x in items:
            out += x[0]
        return out


def canonical_words(code: str) -> list[str]:
    """The words of `code` in canonical order."""
    if "=" not in code and "{" not in code:
        return _WORD.findall(code.lower())
    code = code.lower()
    stack = [_Group("")]
    g, last, before = stack[0], "", ""  # last: the token before, if it can be called; before: the word before that
    for m in _SCAN.finditer(code):
        kind, t = m.lastgroup, m.group()
        if kind == "w":
            g.words.append(t)
            g.first += 1
            before, last = last, t
        elif kind == "s":
            g.words += _WORD.findall(t)
            g.first += 2
            last = ""
        elif t == ",":
            if len(stack) > 1:
                g.items.append((g.words, g.keyword, g.colon))
                g.start()
            last = ""
        elif t in "([{":
            call = t == "(" and (last in (")", "]") or last and last not in _NO_CALL and before not in ("def", "class"))
            g = _Group("call" if call else t)
            stack.append(g)
            last = before = ""
        elif t in ")]}":
            if len(stack) > 1:
                words = stack.pop().finish()
                g = stack[-1]
                g.words += words
                g.first += 2
            before, last = "", t
        else:
            if t == "=" and g.first == 1 and g.words:
                g.keyword = True
            elif t == ":":
                g.colon = True
            g.first += 2
            last = ""
    while len(stack) > 1:  # brackets that were never closed
        words = stack.pop().finish()
        stack[-1].words += words
    return stack[0].finish()


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec_id, key) of every row whose text is neither null nor blank and whose id is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None and c is not None and c.strip():
                    ids.append(i)
                    keys.append(hashlib.blake2b(" ".join(canonical_words(c)).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["rec_id", "key"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "rec_id long, key binary")


def _split(k: DataFrame, hot_rows: int | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Light rows, hot rows and the broadcast hot keys (both null where there are none)."""
    n = k.count()
    least = hot_rows or max(HOT, n // SHARE)
    hot = [r.key for r in k.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("key").collect()]  # at most n / least
    if not hot:
        return k, None, None
    keys = F.broadcast(k.sparkSession.createDataFrame([(bytes(x),) for x in hot], "key binary"))
    return k.join(keys, "key", "left_anti"), k.join(keys, "key"), keys


def copy_groups(df: DataFrame, id_col: str, text_col: str, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: first_id, rec_id of every record that has copies or is one) and (groups: first_id, n_records).

    first_id is the smallest id of the group. Null and blank texts and null ids take no part; re-delivered rows (the
    same id) count once; texts without words are copies of one another. Empty input: empty results.
    """
    k = materialize(keyed(df, id_col, text_col), "p7")
    light, hot, _ = _split(k, hot_rows)
    w = Window.partitionBy("key")
    one = light.repartition("key").dropDuplicates(["key", "rec_id"])  # keeps the partitioning by key
    one = one.select("rec_id", F.min("rec_id").over(w).alias("first_id"), F.count(F.lit(1)).over(w).alias("n_records"))
    members = one.filter(F.col("n_records") > 1)
    groups = members.filter(F.col("rec_id") == F.col("first_id")).select("first_id", "n_records")
    members = members.select("first_id", "rec_id")
    if hot is not None:
        salt = F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).alias("salt")
        once = hot.select("key", "rec_id", salt).groupBy("key", "salt", "rec_id").agg(F.lit(1).alias("one"))
        part = once.groupBy("key", "salt").agg(F.min("rec_id").alias("first_id"), F.count(F.lit(1)).alias("n_records"))
        total = part.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("n_records").alias("n_records"))
        members = members.unionByName(once.join(F.broadcast(total), "key").filter(F.col("n_records") > 1).select("first_id", "rec_id"))
        groups = groups.unionByName(total.filter(F.col("n_records") > 1).select("first_id", "n_records"))
    return members, groups
