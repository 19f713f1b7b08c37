"""Nested filings and price files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexes import parse_date

FILING = "filing_date string, owner bigint, transactions array<struct<tx_id: bigint, code: string, disposed: string, shares: double>>"


def transactions(docs: DataFrame) -> DataFrame:
    """A row for each transaction of JSON filings (column value); malformed text gives none."""
    parsed = docs.select(F.from_json("value", FILING).alias("f"))
    return parsed.select(parse_date(F.col("f.filing_date")).alias("filing_date"), F.col("f.owner").alias("owner"), F.inline("f.transactions"))


def sale_rows(docs: DataFrame) -> DataFrame:
    """Open-market sales: code S, disposed D."""
    return transactions(docs).filter("code = 'S' AND disposed = 'D'").select("tx_id", "owner", "shares", "filing_date")


def merge_bars(old: DataFrame, new: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Bars (issuer, date, close) of two fetches that may differ in basis by a constant factor.

    The factor is the median ratio over common dates. Within ``tolerance`` of 1 stored bars win and
    new dates are appended; otherwise new bars win and stale ones are rescaled. Issuers without
    common dates are left out: they need a fresh fetch.
    """
    both = old.select("issuer", "date", F.col("close").alias("o")).join(new.select("issuer", "date", F.col("close").alias("n")), ["issuer", "date"], "full")
    ratio = both.filter("o IS NOT NULL AND n IS NOT NULL").groupBy("issuer").agg(F.median(F.col("n") / F.col("o")).alias("ratio"))
    same = F.abs(F.col("ratio") - 1) <= tolerance
    return both.join(ratio, "issuer").select("issuer", "date", F.when(same, F.coalesce("o", "n")).otherwise(F.coalesce("n", F.col("o") * F.col("ratio"))).alias("close"))
