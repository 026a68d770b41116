"""Date functions with pandas' results, as column expressions on timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Strftime codes and their Spark patterns.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%A": "EEEE", "%a": "EEE", "%B": "MMMM", "%b": "MMM", "%j": "DDD"}


def parts(c: Column) -> dict[str, Column]:
    """All components; Monday is day 0 of a week."""
    return {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "microsecond": F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)).cast("int"),
        "week": F.weekofyear(c), "dayofweek": F.weekday(c), "dayofyear": F.dayofyear(c), "quarter": F.quarter(c), "days_in_month": F.dayofmonth(F.last_day(c)),
    }


def flags(c: Column) -> dict[str, Column]:
    day, end = F.to_date(c), F.last_day(c)
    first = F.dayofmonth(c) == 1
    return {
        "is_month_start": first, "is_month_end": day == end, "is_quarter_start": first & F.month(c).isin(1, 4, 7, 10), "is_quarter_end": (day == end) & F.month(c).isin(3, 6, 9, 12),
        "is_year_start": first & (F.month(c) == 1), "is_year_end": (day == end) & (F.month(c) == 12), "is_leap_year": F.dayofmonth(F.last_day(F.make_date(F.year(c), F.lit(2), F.lit(1)))) == 29,
    }


def strftime(c: Column, pattern: str) -> Column:
    """Formatted by strftime codes; other text stands for itself."""
    out, plain, i = "", "", 0
    while i < len(pattern):
        code = pattern[i : i + 2]
        if code in STRFTIME:
            out += (f"'{plain}'" if plain else "") + STRFTIME[code]
            plain, i = "", i + 2
        else:
            plain += "%" if code == "%%" else "''" if pattern[i] == "'" else pattern[i]
            i += 2 if code == "%%" else 1
    out += f"'{plain}'" if plain else ""
    return F.date_format(c, out)


def _ticks(c: Column, seconds: int) -> tuple[Column, Column]:
    return F.unix_micros(c.cast("timestamp")), F.lit(seconds * 1_000_000)


def _back(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")


def floor_to(c: Column, seconds: int) -> Column:
    m, t = _ticks(c, seconds)
    return _back(F.floor(m / t) * t)


def ceil_to(c: Column, seconds: int) -> Column:
    m, t = _ticks(c, seconds)
    return _back(F.ceil(m / t) * t)


def round_to(c: Column, seconds: int) -> Column:
    """To the nearest tick, halves to the even one."""
    m, t = _ticks(c, seconds)
    return _back(F.rint(m / t) * t)


def period(c: Column, unit: str) -> Column:
    """Label of the year, quarter, month or day."""
    return {"year": F.date_format(c, "yyyy"), "quarter": F.concat(F.date_format(c, "yyyy"), F.lit("Q"), F.quarter(c)), "month": F.date_format(c, "yyyy-MM"), "day": F.date_format(c, "yyyy-MM-dd")}[unit]


def month_end(c: Column, n: int = 1) -> Column:
    """n month ends on; a date that is no month end first goes to the end of its month."""
    d = F.to_date(c)
    at_end = d == F.last_day(d)
    return F.last_day(F.add_months(d, F.lit(n) - F.when(at_end, 0).otherwise(1 if n > 0 else 0)))


def business_days(start: Column, stop: Column) -> Column:
    """Array of the Mondays to Fridays from start to stop."""
    return F.filter(F.sequence(F.to_date(start), F.to_date(stop)), lambda x: F.weekday(x) < 5)


def add_business_days(c: Column, n: int) -> Column:
    """n business days on (n >= 0); a weekend counts from the Friday before."""
    d = F.to_date(c)
    w = F.weekday(d)
    base = F.date_sub(d, F.greatest(w - 4, F.lit(0)))
    k = F.least(w, F.lit(4)) + n
    return F.date_add(base, (F.floor(k / 5) * 7 + k % 5 - F.least(w, F.lit(4))).cast("int"))


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian rule."""
    q = lambda a, n: F.floor(a / n).cast("int")
    a, b, c = year % 19, q(year, 100), year % 100
    h = (19 * a + b - q(b, 4) - q(b - q(b + 8, 25) + 1, 3) + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * q(c, 4) - h - c % 4) % 7  # noqa: E741
    m = q(a + 11 * h + 22 * l, 451)
    n = h + l - 7 * m + 114
    return F.make_date(year, q(n, 31), n % 31 + 1)


def period_edge(c: Column, unit: str, n: int = 1, end: bool = True) -> Column:
    """n ends (or begins) of month, quarter, year or week (Sunday ends it) on; n < 0 goes back.

    A date that is on an edge moves by whole periods; any other first goes to the next edge (the one before, if n < 0).
    """
    d = F.to_date(c)
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    begin = F.trunc(d, unit)
    move = lambda x, k: F.add_months(x, k * months) if months else F.date_add(x, k * 7)
    last = F.date_sub(move(begin, F.lit(1)), 1)
    if end:
        k = F.when(d == last, F.lit(n)).otherwise(F.lit(n - 1 if n > 0 else n))
        return F.date_sub(move(begin, k + 1), 1)
    k = F.when(d == begin, F.lit(n)).otherwise(F.lit(n if n > 0 else n + 1))
    return move(begin, k)


def semi_month_end(c: Column) -> Column:
    """The next 15th or last day of a month after the date."""
    d = F.to_date(c)
    return F.when(F.dayofmonth(d) < 15, F.date_add(F.trunc(d, "month"), 14)).when(d < F.last_day(d), F.last_day(d)).otherwise(F.date_add(d, 15))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (0 is Monday) of a month, counted from its end if n < 0."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, ((F.lit(weekday) - F.weekday(first) + 7) % 7 + (n - 1) * 7).cast("int"))
    last = F.last_day(first)
    return F.date_sub(last, ((F.weekday(last) - F.lit(weekday) + 7) % 7 + (-n - 1) * 7).cast("int"))


def observed(c: Column) -> Column:
    """The Friday before a Saturday, the Monday after a Sunday."""
    return F.when(F.weekday(c) == 5, F.date_sub(c, 1)).when(F.weekday(c) == 6, F.date_add(c, 1)).otherwise(c)


def federal_holidays(year: Column) -> Column:
    """Array of the observed holidays of the United States in a year, by the rules that hold since 2021."""
    on = lambda m, d: observed(F.make_date(year, F.lit(m), F.lit(d)))
    return F.array(
        on(1, 1), nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), nth_weekday(year, 5, 0, -1), on(6, 19), on(7, 4),
        nth_weekday(year, 9, 0, 1), nth_weekday(year, 10, 0, 2), on(11, 11), nth_weekday(year, 11, 3, 4), on(12, 25),
    )


def fiscal_year_end(year: Column, month: int, weekday: int, nearest: bool = False) -> Column:
    """The end of a year of 52 or 53 weeks: the last such weekday of the month, or the one nearest to the month's end."""
    last = nth_weekday(year, month, weekday, -1)
    if not nearest:
        return last
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.when(F.date_diff(end, last) <= 3, last).otherwise(F.date_add(last, 7))


def seconds_of(c: Column) -> Column:
    """Seconds of a duration such as `2 days 03:04:05.5` or `-1 days`; null if it is none."""
    part = lambda g: F.regexp_extract(c, r"^\s*(?:(-?\d+) days?)?\s*(?:(\d+):(\d\d):(\d\d(?:\.\d+)?))?\s*$", g)
    n = lambda g: F.coalesce(F.nullif(part(g), F.lit("")).cast("double"), F.lit(0.0))
    ok = (part(1) != "") | (part(2) != "")
    return F.when(ok, n(1) * 86_400 + n(2) * 3_600 + n(3) * 60 + n(4))


def time_of(c: Column) -> Column:
    """Time of day as HH:mm:ss from `H:M`, `H:M:S` or `H:M AM`; null if it is none."""
    part = lambda g: F.regexp_extract(c, r"(?i)^\s*(\d{1,2}):(\d\d)(?::(\d\d))?\s*([ap]m)?\s*$", g)
    h = F.nullif(part(1), F.lit("")).cast("int")
    half = F.lower(part(4))
    hour = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
    ok = (hour < 24) & (F.nullif(part(2), F.lit("")).cast("int") < 60)
    second = F.when(part(3) == "", F.lit("00")).otherwise(part(3))
    return F.when(ok, F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), part(2), second))
