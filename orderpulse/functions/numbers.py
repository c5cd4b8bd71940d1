"""Locale-aware number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text Python's float() accepts (without underscores / inf / nan).
_NUMERIC_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _locale_text(value: Column) -> Column:
    """Rewrite ``1.234,56`` / ``123,45`` to dot-decimal text; leave others alone."""
    s = F.trim(value.cast("string"))
    has_comma = F.instr(s, ",") > 0
    has_dot = F.instr(s, ".") > 0
    comma_last = s.rlike(r",[^.]*$")
    return (
        F.when(has_comma & has_dot & comma_last, F.translate(F.translate(s, ".", ""), ",", "."))
        .when(has_comma & ~has_dot, F.translate(s, ",", "."))
        .otherwise(s)
    )


def lenient_double(value: Column) -> Column:
    """Dot-decimal text -> double, null when not a plain number.

    The regex guard is needed: Spark's cast accepts ``'12d'`` as 12.0."""
    s = F.trim(value.cast("string"))
    return F.when(s.rlike(_NUMERIC_TEXT), s.try_cast("double"))


def locale_number(value: Column) -> Column:
    """Locale number -> double; failure or null -> 0.0."""
    return F.coalesce(lenient_double(_locale_text(value)), F.lit(0.0))


def locale_int(value: Column) -> Column:
    """Locale number truncated toward zero; failure -> 0."""
    d = lenient_double(_locale_text(value))
    return F.coalesce(F.when(F.abs(d) < 9.2e18, d.cast("long")), F.lit(0).cast("long"))


def locale_decimal(value: Column) -> Column:
    """Locale number -> decimal(28,2) HALF_UP; null/'' -> 0.00; unparsable -> null.

    A null result for non-empty input marks the row as rejected."""
    s = F.trim(value.cast("string"))
    t = _locale_text(value)
    dec = F.when(t.rlike(_NUMERIC_TEXT), t.try_cast("decimal(38,10)")).cast("decimal(28,2)")
    return F.when(value.isNull() | (s == ""), F.lit(0).cast("decimal(28,2)")).otherwise(dec)


def order_code(value: Column) -> Column:
    """Order/EAN text (P07): 12-14 digits kept; ``1.23E+12`` -> integer text; else trimmed.

    An exponent beyond 38 digits keeps its text."""
    s = F.trim(value.cast("string"))
    sci = F.when(s.rlike(r"^\d+\.\d+E\+\d+$"),
                 s.try_cast("double").try_cast("decimal(38,0)").cast("string"))
    return F.when(value.isNull(), F.lit("")).otherwise(F.coalesce(sci, s))


def cents(value: Column) -> Column:
    """Money (2 decimal places) as a whole number of cents."""
    return F.round(value.cast("double") * 100).cast("long")


def money_sum(value: Column) -> Column:
    """Exact, order-independent sum of 2-place money values (returned as double).

    A plain double ``sum`` depends on the order partial sums arrive in, so two
    evaluations can differ in the last bit; summing whole cents as ``long`` does
    not. Null-only input sums to 0.0."""
    return F.coalesce(F.sum(cents(value)) / F.lit(100.0), F.lit(0.0))
