"""Column-name mapping on ``df.columns`` (P01, P02, P27, P31): metadata only, no job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.text import normalize_name
from orderpulse.schemas import FUZZY_KEYWORDS


def exact_alias_map(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Canonical -> source column where ``lower(trim(name))`` equals an alias
    (first alias in list order; with repeated names the last column wins)."""
    by_norm = {str(c).lower().strip(): c for c in columns}
    out = {}
    for canon, alts in aliases.items():
        for a in alts:
            if a in by_norm:
                out[canon] = by_norm[a]
                break
    return out


def apply_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Add canonical columns next to their sources."""
    m = exact_alias_map(df.columns, aliases)
    return df.withColumns({canon: F.col(f"`{src}`") for canon, src in m.items()}) if m else df


def fuzzy_column(columns: list[str], keywords: list[str]) -> str | None:
    """First column whose normalised name contains a normalised keyword;
    keyword order first, then column order."""
    norm = [(normalize_name(c), c) for c in columns]
    for kw in keywords:
        k = normalize_name(kw)
        for n, original in norm:
            if k in n:
                return original
    return None


def fuzzy_map(columns: list[str], targets: dict[str, list[str]] = FUZZY_KEYWORDS) -> dict[str, str | None]:
    return {t: fuzzy_column(columns, kws) for t, kws in targets.items()}


def first_present(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in columns), None)


def lower_trim_columns(df: DataFrame) -> DataFrame:
    """Column names lower-cased and trimmed."""
    return df.toDF(*[str(c).strip().lower() for c in df.columns])
