"""Tickers that change hands: adjacent spans of identities, their classes, and the spans that are safe to price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import block_ratio
from ..functions.text_rules import normalize_name

#: Similarities from which names are alike and below which they are not, and the longest gap of a rename in days.
ALIKE = 0.85
UNLIKE = 0.65
GAP = 400


def spans(events: DataFrame) -> DataFrame:
    """(ticker, cik, name, first, last, n) of events (ticker, cik, name, filing_date); the name is that of the latest row."""
    kept = events.filter("ticker IS NOT NULL AND cik IS NOT NULL")
    return kept.groupBy("ticker", "cik").agg(F.max_by("name", F.struct("filing_date", "name")).alias("name"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"), F.count("*").alias("n"))


def transitions(events: DataFrame) -> DataFrame:
    """One row for each pair of adjacent spans of a ticker, in order of first filing, with its class and the facts behind it."""
    all_spans = spans(events)
    by_ticker = Window.partitionBy("ticker").orderBy("first", "cik")
    earlier = F.lag(F.struct("cik", "name", "last")).over(by_ticker)
    pairs = all_spans.withColumn("a", earlier).filter("a IS NOT NULL").select("ticker", F.col("a.cik").alias("cik_a"), F.col("a.name").alias("name_a"), F.col("a.last").alias("last_a"), F.col("cik").alias("cik_b"), F.col("name").alias("name_b"), F.col("first").alias("first_b"))
    others = all_spans.select(F.col("cik").alias("c"), F.col("ticker").alias("t"), F.col("first").alias("f"), F.col("last").alias("l"))
    identity = pairs.join(others, (F.col("cik_b") == F.col("c")) & (F.col("t") != F.col("ticker")), "left").groupBy(*pairs.columns).agg(F.coalesce(F.bool_or(F.col("f") < F.col("first_b")), F.lit(False)).alias("prior_identity"))
    facts = identity.withColumn("gap", F.datediff("first_b", "last_a")).withColumn("similarity", F.round(block_ratio(normalize_name(F.col("name_a")), normalize_name(F.col("name_b"))), 4))
    kind = F.when(F.col("prior_identity"), "REUSE").when(F.col("similarity") >= ALIKE, "RENAME").when(F.col("similarity") < UNLIKE, "REUSE").when(F.col("gap") <= GAP, "RENAME").otherwise("AMBIGUOUS")
    return facts.withColumn("kind", kind)


def unsafe_spans(changes: DataFrame) -> DataFrame:
    """(ticker, cik) of spans before the newest change that is no rename, walked from the newest back."""
    newest_first = Window.partitionBy("ticker").orderBy(F.desc("first_b"), F.desc("cik_b")).rowsBetween(Window.unboundedPreceding, 0)
    walked = changes.withColumn("cut", F.bool_or(F.col("kind") != "RENAME").over(newest_first))
    return walked.filter("cut").select("ticker", F.col("cik_a").alias("cik")).distinct()


def safe_events(events: DataFrame) -> DataFrame:
    """Events whose identity continues into the ticker's present one; rows without a ticker or identity stay."""
    return events.join(unsafe_spans(transitions(events)), ["ticker", "cik"], "left_anti")
