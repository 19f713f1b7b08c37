"""Text and label rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corporate words that name comparison ignores.
SUFFIXES = "INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|HOLDINGS|HOLDING|GROUP|LLC|LLP|LP|LTD|LIMITED|PLC|THE"

#: Placeholders that are no ticker.
NO_TICKER = ("--", "-", "N/A", "NA", "NONE", "NAN", "NULL")

#: Characters that wrap a ticker, and the form of one.
WRAPPING = r"[\s\"'(\[?\])]"
TICKER_FORM = r"^[A-Z][A-Z0-9]{0,6}([.-][A-Z0-9]{1,4})?$"

#: Words of a footnote that tell of a routine purchase.
ROUTINE_NOTE = r"(?i)ESPP|Employee\s+Stock\s+Purchase|401\s*\(?\s*k\s*\)?|Dividend\s+Reinvest|\bDRIP\b|payroll\s+deduction|automatic\s+(purchase|investment|acquisition)"


def normalize_ticker(raw: Column) -> Column:
    """Upper-case, strip wrappers and an exchange prefix, drop placeholders, take the first token, check the form; null if unusable."""
    t = F.regexp_replace(F.upper(raw), rf"^{WRAPPING}+|{WRAPPING}+$", "")
    t = F.trim(F.regexp_replace(t, r"^[A-Z]+:\s*", ""))
    first = F.regexp_extract(t, r"^[,;/\s(]*([^,;/\s(]+)", 1)
    return F.when(~t.isin(*NO_TICKER) & F.regexp_like(first, F.lit(TICKER_FORM)), first)


def normalize_cik(raw: Column) -> Column:
    """The digits, padded with zeros to ten."""
    return F.lpad(F.regexp_replace(raw, "[^0-9]", ""), 10, "0")


def normalize_name(raw: Column) -> Column:
    """Upper case without a state tag or OLD mark at the end, punctuation and corporate words; null counts as empty."""
    t = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"-\s*OLD\s*$", " ")
    t = F.regexp_replace(t, r"[/\\]\s*[A-Z]{2,4}\s*[/\\]?\s*$", " ")
    t = F.regexp_replace(t, r"[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"\b({SUFFIXES})\b", " "), r"\s+", " "))


def role_string(director: Column, officer: Column, ten: Column) -> Column:
    parts = F.concat_ws(", ", F.when(director, "Director"), F.when(officer, "Officer"), F.when(ten, "10% Owner"))
    return F.when(parts == "", "Unknown").otherwise(parts)


def verdict(percentile: Column, missing: Column) -> Column:
    """Bands at 30, 70 and 90; unavailable when over half of the inputs are missing or there is no percentile."""
    return F.when(percentile.isNull() | F.isnan(percentile) | (missing > 0.5), "unavailable").when(percentile >= 90, "strong").when(percentile >= 70, "good").when(percentile >= 30, "neutral").otherwise("weak")


def first_case(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for condition, name in cases:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)
