"""Ticker reuse against the rules by hand."""

import datetime as dt
import difflib

from pyspark.sql import functions as F

from tidemark.functions.similarity import block_ratio
from tidemark.operators import reuse


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_similarity_is_the_matcher_s(spark):
    pairs = [("APACHE", "APA"), ("AKOUSTIS", "AKTS"), ("", "A"), (None, "A"), ("SAME", "SAME")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(block_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


def test_transitions_and_safe_spans(spark):
    rows = [
        ("A", 1, "Apache Corp", 0), ("A", 1, "Apache Corp", 10), ("A", 2, "APACHE INC", 500), ("A", 2, "Apache", 600),  # alike: a rename
        ("B", 3, "Zebra", 0), ("B", 4, "Quilt Works", 20), ("B", 5, "Quilt Works Ltd", 40),  # unlike, then a rename
        ("C", 6, "Apache", 0), ("C", 7, "APA", 399), ("D", 8, "Apache", 0), ("D", 9, "APA", 402),  # in between: by the gap
        ("E", 10, "Same", 100), ("E", 11, "Same", 300), ("F", 11, "Same", 50),  # the successor was known elsewhere before
        (None, 12, "x", 0), ("G", None, "x", 0), ("H", 13, "alone", 0),
    ]
    events = spark.createDataFrame([(t, c, n, day(d)) for t, c, n, d in rows], "ticker string, cik long, name string, filing_date date")
    found = {(r["ticker"], r["cik_a"], r["cik_b"]): r["kind"] for r in reuse.transitions(events).collect()}
    assert found == {("A", 1, 2): "RENAME", ("B", 3, 4): "REUSE", ("B", 4, 5): "RENAME", ("C", 6, 7): "RENAME", ("D", 8, 9): "AMBIGUOUS", ("E", 10, 11): "REUSE"}
    left = reuse.safe_events(events)
    assert {(r["ticker"], r["cik"]) for r in events.join(left, ["ticker", "cik", "filing_date"], "left_anti").filter(F.col("ticker").isNotNull() & F.col("cik").isNotNull()).collect()} == {("B", 3), ("D", 8), ("E", 10)}
