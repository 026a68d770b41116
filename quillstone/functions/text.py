"""String functions with pandas' results, as column expressions; Python only where Spark has no such function."""

from __future__ import annotations

import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


def split_words(c: Column) -> Column:
    """Split at runs of white space; no empty parts at the ends."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(c.isNull(), None).when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def rsplit(c: Column, sep: str, n: int) -> Column:
    """At most n splits from the right."""
    parts = F.split(c, _literal(sep))
    keep = F.greatest(F.size(parts) - n, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), keep), sep)), F.filter(parts, lambda x, i: i >= keep))


def partition(c: Column, sep: str) -> Column:
    """struct(head, sep, tail) at the first separator; without one (text, '', '')."""
    at = F.instr(c, sep)
    n = len(sep)
    return F.when(at > 0, F.struct(F.substring(c, F.lit(1), at - 1).alias("head"), F.lit(sep).alias("sep"), F.substring(c, at + n, F.length(c)).alias("tail"))).otherwise(F.struct(c.alias("head"), F.lit("").alias("sep"), F.lit("").alias("tail")))


def rpartition(c: Column, sep: str) -> Column:
    """As partition, at the last separator; without one ('', '', text)."""
    rest = F.element_at(F.split(c, _literal(sep)), -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(rest) - len(sep))
    return F.when(F.contains(c, F.lit(sep)), F.struct(head.alias("head"), F.lit(sep).alias("sep"), rest.alias("tail"))).otherwise(F.struct(F.lit("").alias("head"), F.lit("").alias("sep"), c.alias("tail")))


def _literal(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def slice_text(c: Column, start: int = 0, stop: int | None = None) -> Column:
    """text[start:stop] with negative places from the end."""
    n = F.length(c)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))


def pad(c: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Padded to a width; longer texts stay whole."""
    n = F.length(c)
    if side == "both":
        total = F.lit(width) - n
        left = F.floor(total / 2) + F.when((total % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
        out = F.rpad(F.lpad(c, (n + left).cast("int"), fill), width, fill)
    else:
        out = F.lpad(c, width, fill) if side == "left" else F.rpad(c, width, fill)
    return F.when(n >= width, c).otherwise(out)


def zfill(c: Column, width: int) -> Column:
    """Zeros after a sign."""
    signed = F.substring(c, 1, 1).isin("+", "-")
    body = F.when(signed, F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    return F.when(F.length(c) >= width, c).when(signed, F.concat(F.substring(c, 1, 1), F.lpad(body, width - 1, "0"))).otherwise(F.lpad(c, width, "0"))


def find(c: Column, sub: str) -> Column:
    """0-based place of the first occurrence, -1 without one."""
    return F.instr(c, sub) - 1


def rfind(c: Column, sub: str) -> Column:
    at = F.instr(F.reverse(c), sub[::-1])
    return F.when(at > 0, F.length(c) - at - len(sub) + 1).when(c.isNotNull(), F.lit(-1))


def index(c: Column, sub: str) -> Column:
    """As find, but an error without an occurrence."""
    return F.when(F.instr(c, sub) > 0, F.instr(c, sub) - 1).when(c.isNotNull(), F.raise_error(F.lit("substring not found")).cast("int"))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match."""
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def contains(c: Column, pattern: str, regex: bool = True, na: bool = False) -> Column:
    hit = F.rlike(c, F.lit(pattern)) if regex else F.contains(c, F.lit(pattern))
    return F.coalesce(hit, F.lit(na))


def match(c: Column, pattern: str, na: bool = False) -> Column:
    """Whether the text begins with a match."""
    return F.coalesce(F.rlike(c, F.lit(f"^(?:{pattern})")), F.lit(na))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def swapcase(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == F.lower(x), F.upper(x)).otherwise(F.lower(x))), "")


#: Patterns of the character-class predicates; the empty text meets none.
CLASSES = {"isalnum": r"^[\p{L}\p{N}]+$", "isalpha": r"^\p{L}+$", "isdigit": r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$", "isdecimal": r"^\p{Nd}+$", "isnumeric": r"^\p{N}+$", "isspace": r"^(?U:\s)+$"}


def is_class(c: Column, name: str) -> Column:
    if name in ("islower", "isupper"):
        same = (F.lower(c) if name == "islower" else F.upper(c)) == c
        return F.coalesce(same & F.rlike(c, F.lit(r"\p{L}")) & (F.lower(c) != F.upper(c)), F.lit(False))
    return F.coalesce(F.rlike(c, F.lit(CLASSES[name])), F.lit(False))


def dummies(df: DataFrame, column: str, values: list[str], sep: str = "|") -> DataFrame:
    """An indicator column per value of a delimited text."""
    have = F.split(F.col(column), _literal(sep))
    return df.select("*", *[F.coalesce(F.array_contains(have, v).cast("int"), F.lit(0)).alias(v) for v in values])


@F.pandas_udf(StringType())
def title(s: pd.Series) -> pd.Series:
    """Every run of letters capitalised (Spark's initcap goes by blanks)."""
    return s.str.title()


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def normalize(form: str):
    """NFC, NFD, NFKC or NFKD of a column."""

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return f


def wrap(width: int):
    """Lines of at most `width` characters."""

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "\n".join(textwrap.wrap(x, width)))

    return f


def cat(columns: list[Column], sep: str = "", na_rep: str | None = None) -> Column:
    """Texts put together; with a missing one the result is missing, unless na_rep stands in for it."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit(sep)] if i else []) + [c if na_rep is None else F.coalesce(c, F.lit(na_rep))]])


def extractall(df: DataFrame, column: str, pattern: str, match: str = "match", value: str = "value") -> DataFrame:
    """A row for every match of the first group: the row's columns, the number of the match and the text."""
    return df.select("*", F.posexplode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias(match, value))


def wrap(c: Column, width: int) -> Column:
    """Lines of at most `width` letters, broken at blanks; longer words stand alone."""
    words = F.split(F.trim(c), r"\s+")
    fold = lambda acc, w: F.when(F.length(acc["line"]) == 0, F.struct(acc["done"].alias("done"), w.alias("line"))).when(F.length(acc["line"]) + 1 + F.length(w) <= width, F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), w).alias("line"))).otherwise(F.struct(F.concat(acc["done"], acc["line"], F.lit("\n")).alias("done"), w.alias("line")))
    return F.aggregate(words, F.struct(F.lit("").alias("done"), F.lit("").alias("line")), fold, lambda acc: F.concat(acc["done"], acc["line"]))
