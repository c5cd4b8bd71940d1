"""Date/time helpers. All instants are wall-clock ``timestamp_ntz`` so results do
not depend on the session time zone."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# The two common shapes (P06/P17): day-month-year or year-month-day with '/', '-' or
# '.', optional time (H:mm[:ss[.fff]]) after a space or 'T'.
_TIME = r"(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?)?"
_DMY = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})" + _TIME + r"$"
_YMD = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})" + _TIME + r"$"

# Month names as the reproduced parser knows them.
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december"]
_MONTH = "(" + "|".join(f"{m}|{m[:3]}" if m != "may" else m for m in _MONTHS) + ")"
_DAY_NAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?"
# hour, minute, second, half of the day, zone
_CLOCK = (r"(?:(?:,? |T)(\d{1,2})(?:[:h](\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?)? ?([ap]m)?)?"
          r" ?(z|utc|gmt|[+-]\d{2}:?\d{2})?")
_TIGHT_CLOCK = r"(?:[T ]?(\d{2})(\d{2})(\d{2}(?:\.\d{1,6})?)?)?()(z|utc|gmt|[+-]\d{2}:?\d{2})?"

# All shapes of date text, tried in this order, once each: what its numbers allow (y: year-month-day
# or year-day-month, d: day and month in either order, n: one reading), the pattern, and which of
# its groups are year, month and day (0: the first).
_SHAPES = [
    ("d", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})" + _CLOCK, (3, 2, 1)),
    ("y", r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})" + _CLOCK, (1, 2, 3)),
    ("y", r"(\d{4})(\d{2})(\d{2})" + _TIGHT_CLOCK, (1, 2, 3)),
    ("n", _DAY_NAME + r"(\d{1,2})(?:\. ?|[ /-])" + _MONTH + r"\.?,?[ /-](\d{4}|\d{2})" + _CLOCK, (3, 2, 1)),
    ("n", _DAY_NAME + _MONTH + r"\.?[ /-](\d{1,2}),?[ /-](\d{4})" + _CLOCK, (3, 1, 2)),
    ("n", r"(\d{4})[ /-]" + _MONTH + r"[ /-](\d{1,2})" + _CLOCK, (1, 2, 3)),
    ("n", _MONTH + r"[ /-](\d{4})", (2, 1, 0)),
    ("n", r"(\d{4})[-/](\d{1,2})", (1, 2, 0)),
    ("n", r"(\d{1,2})[-/](\d{4})", (2, 1, 0)),
    ("n", r"(1[7-9]\d{2}|2[01]\d{2})", (1, 0, 0)),
]

#: Zone in which dates without a zone are wall-clock times.
LOCAL_ZONE = "America/Sao_Paulo"


def ts_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from ``datetime``/``date``/ISO text."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def _micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def floor_days(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``, floored (Python ``timedelta.days``).

    Not ``datediff``: that counts midnights crossed (P34)."""
    us = _micros_between(start, end)
    return ((us - F.pmod(us, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("long")


def add_days(ts: Column, days: Column) -> Column:
    """``ts + timedelta(days=days)`` for fractional ``days`` (microsecond precision)."""
    micros = F.round(days.cast("double") * F.lit(float(MICROS_PER_DAY))).cast("long")
    return F.timestamp_add("MICROSECOND", micros, ts)


def month_start(ts: Column) -> Column:
    """Calendar month bucket (P28) as a date."""
    return F.trunc(ts.cast("date"), "month")


def _year(y: Column) -> Column:
    """Two-digit years: 00-68 -> 2000s, 69-99 -> 1900s (strptime's rule)."""
    return F.when(y < 100, F.when(y < 69, y + 2000).otherwise(y + 1900)).otherwise(y)


def _fields(text: Column) -> Column:
    """``kind|year|month|day|hour|minute|second|half|zone`` of text in a known shape, else null."""
    out = None
    for kind, date, order in _SHAPES:
        pattern = rf"(?i)^{date}$"
        clock = range(len([g for g in order if g]) + 1, re.compile(date).groups + 1)
        fields = [f"${g}" if g else "1" for g in order] + [f"${g}" for g in clock]
        fields += [""] * (8 - len(fields))
        here = text.rlike(pattern), F.regexp_replace(text, pattern, "|".join([kind, *fields]))
        out = F.when(*here) if out is None else out.when(*here)
    return out


def _assembled(f: Column, dayfirst: bool, zone: str) -> Column:
    """Timestamp of an array of fields; null if impossible."""
    def number(i):
        return F.get(f, F.lit(i)).try_cast("int")
    year = _year(number(1))
    names = F.lit("".join(m[:3] for m in _MONTHS))
    month = F.coalesce(number(2), ((F.instr(names, F.lower(F.substring(F.get(f, F.lit(2)), 1, 3))) + 2) / 3).cast("int"))
    day, half = number(3), F.lower(F.get(f, F.lit(7)))
    hour, minute = F.coalesce(number(4), F.lit(0)), F.coalesce(number(5), F.lit(0))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    second = F.coalesce(F.get(f, F.lit(6)).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    ways = [F.try_make_timestamp_ntz(year, mo, d, hour, minute, second) for mo, d in ((month, day), (day, month))]
    kind = F.get(f, F.lit(0))
    ts = F.when(kind == "n", ways[0]).otherwise(F.coalesce(*ways))
    if not dayfirst:
        ts = F.when(kind == "d", F.coalesce(*reversed(ways))).otherwise(ts)
    at = F.upper(F.get(f, F.lit(8)))
    sign = F.when(at.startswith("-"), -1).otherwise(1)
    digits = F.replace(at, F.lit(":"), F.lit(""))
    offset = F.when(at.rlike("^[+-]"), sign * (F.substring(digits, 2, 2).try_cast("int") * 60
                                               + F.substring(digits, 4, 2).try_cast("int"))).otherwise(0)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MINUTE", -offset, ts))
    return F.when(at == "", ts).otherwise(local)


def parse_date(value: Column, dayfirst: bool = True, fallback: Column | None = None, zone: str = LOCAL_ZONE) -> Column:
    """Lenient text -> timestamp_ntz (P06/P17/P29/P30); unparsable -> null or ``fallback``.

    Year-first text is read year-month-day (Q1); other numeric dates are day-first unless
    ``dayfirst`` is false; a numeric date that is impossible that way is tried the other way round
    (``12/31/2024``). Times may have seconds, AM/PM, ``14h30`` or a zone; an instant with a zone
    becomes wall-clock time of ``zone``. Month names are English; month and year, or a year alone,
    mean their first day.

    The two common shapes cost one regex and one ``split`` each. Only text of neither goes through
    ``_SHAPES``: the first that fits rewrites it to its fields, bound once as a lambda's variable so
    that the generated code stays small. ``try_make_timestamp_ntz`` assembles (31/02 is null)."""
    text = F.trim(value.cast("string"))

    def common(date):
        """``date`` of the numbers of text in a common shape, which are split once: ``at(i)`` is the i-th."""
        def of(parts):
            def at(i):
                return F.try_element_at(parts, F.lit(i)).cast("int")
            frac = F.coalesce(F.try_element_at(parts, F.lit(7)), F.lit("0"))
            sec = F.concat(F.coalesce(F.try_element_at(parts, F.lit(6)), F.lit("0")), F.lit("."), frac) \
                .cast("decimal(16,6)")
            year, month, day = date(at)
            swap = (month > 12) & (day <= 12)
            return F.try_make_timestamp_ntz(year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day),
                                            F.coalesce(at(4), F.lit(0)), F.coalesce(at(5), F.lit(0)), sec)
        # one separator first: a split by a pattern compiles it for every row
        return F.get(F.transform(F.array(F.split(F.translate(text, ".: T-", "/////"), "/")), of), F.lit(0))
    month, day = (2, 1) if dayfirst else (1, 2)
    other = F.get(F.transform(F.array(F.split(_fields(text), r"\|", -1)), lambda f: _assembled(f, dayfirst, zone)), F.lit(0))
    parsed = (F.when(text.rlike(_DMY), common(lambda at: (_year(at(3)), at(month), at(day))))
              .when(text.rlike(_YMD), common(lambda at: (at(1), at(2), at(3))))
              .when(text.rlike("[0-9]"), other))  # every shape has a number
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def to_utc(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Naive local wall-clock in ``zone`` -> UTC wall-clock (P09), whatever the session zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))
