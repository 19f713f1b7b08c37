"""Sinks: versioned Parquet, CSV by run, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_events(rows: DataFrame, path: str, date: str = "tx_date") -> DataFrame:
    """Write partitioned by year and return the manifest: rows and date range of each year.

    Spark's committer makes the write visible as a whole; a failed attempt leaves no rows behind.
    """
    dated = rows.withColumn("year", F.year(date))
    dated.write.mode("overwrite").partitionBy("year").parquet(path)
    written = rows.sparkSession.read.parquet(path)
    return written.groupBy("year").agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def save_runs(rows: DataFrame, path: str, *by: str) -> None:
    """CSV files in a folder for each run."""
    rows.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)


def to_payload(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct("*")).alias("payload"))
