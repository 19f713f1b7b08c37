"""Text indexes of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_index_lines(lines: DataFrame, forms: tuple[str, ...] = ("4", "4/A")) -> DataFrame:
    """(form, name, cik, filed, file_name) from lines of text (column value).

    The form stands in the first 12 columns; id, date and file are the last three tokens, so names
    may hold blanks. Lines of other forms and lines without three tokens are left out.
    """
    form = F.trim(F.substring("value", 1, 12))
    tail = r"^(.*?)\s+(\S+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"
    rest = F.substring("value", 13, 1_000_000)
    kept = lines.filter(form.isin(*forms) & F.regexp_like(rest, F.lit(tail)))
    part = lambda k: F.regexp_extract(rest, tail, k)
    return kept.select(form.alias("form"), F.trim(part(1)).alias("name"), part(2).alias("cik"), parse_date(part(3)).alias("filed"), part(4).alias("file_name"))


def parse_date(raw):
    """A date written yyyyMMdd or yyyy-MM-dd; null otherwise."""
    return F.coalesce(F.try_to_date(raw, "yyyyMMdd"), F.try_to_date(raw, "yyyy-MM-dd"))


def missing_weekdays(days: DataFrame, first: str, last: str) -> DataFrame:
    """Weekdays between two dates that ``days`` (day) lacks."""
    spark = days.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).filter(F.weekday("day") < 5)
    return wanted.join(days.select("day").distinct(), "day", "left_anti")


#: Files that are no ownership document, and names to prefer, in order.
NOT_OWNERSHIP = ("filingsummary.xml", "metadata.xml")
PREFERRED = ("primary_doc.xml", "form4.xml", "form3.xml", "form5.xml")


def pick_document(files: DataFrame) -> DataFrame:
    """(filing, name): of a filing's files (filing, name, place) the preferred XML file, else one named after a form, else the first."""
    low = F.lower("name")
    kept = files.filter(low.endswith(".xml") & ~low.isin(*NOT_OWNERSHIP) & ~F.regexp_like(low, F.lit(r"^r\d+\.xml$")))
    rank = F.lit(len(PREFERRED) + 1)
    rank = F.when(F.regexp_like(low, F.lit(r"form[345]|^wf-form")), len(PREFERRED)).otherwise(rank)
    for k in reversed(range(len(PREFERRED))):
        rank = F.when(low == PREFERRED[k], k).otherwise(rank)
    return kept.groupBy("filing").agg(F.min_by("name", F.struct(rank, "place")).alias("name"))
