"""Binding of the engine's concepts onto the driver's star schema, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Transaction codes: purchase, sale, grant, exercise.
BUY, SALE, GRANT, EXERCISE = "AO", "RF", "NO", "NF"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a transaction: issuer, owner, dates, code, amounts and the owner's roles."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    tx = F.col("l_shipdate").cast("date")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("l_suppkey").alias("issuer"), F.col("o_custkey").alias("owner"), F.col("c_name").alias("owner_name"), tx.alias("tx_date"),
        F.date_add(tx, (F.col("l_orderkey") % 20).cast("int")).alias("filing_date"), F.concat("l_returnflag", "l_linestatus").alias("code"),
        F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("value"),
        (F.lit(100.0) / F.col("l_linenumber")).alias("pct"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_director"),
        (F.col("o_orderpriority") == "3-MEDIUM").alias("is_officer"), (F.col("c_mktsegment") == "BUILDING").alias("is_ten"), (F.col("l_tax") >= 0.07).alias("is_plan"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx_id"),
    )


def of_code(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    return filings(spark, sf_dir).filter(F.col("code") == code)


def buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_code(spark, sf_dir, BUY)


def bars(spark: SparkSession, sf_dir: str, *, together: bool = False) -> DataFrame:
    """Daily bars of each issuer: open and close are the first and last transaction's price.

    ``together`` deals the transactions out by issuer once, for plans that go on by issuer.
    """
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    line = line.repartition("l_suppkey") if together else line
    price, tx_id = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.groupBy(F.col("l_suppkey").alias("issuer"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min_by(price, tx_id).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, tx_id).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("dollar_volume"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, idx): trading days by position. One row a day, so one small window."""
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return days.withColumn("idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, level): the market bar."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("level"))


SQL = """
filings AS (
  SELECT l_suppkey AS issuer, o_custkey AS owner, c_name AS owner_name, CAST(l_shipdate AS DATE) AS tx_date,
         CAST(l_shipdate AS DATE) + CAST(l_orderkey % 20 AS INTEGER) AS filing_date, l_returnflag || l_linestatus AS code,
         l_quantity AS shares, l_extendedprice / l_quantity AS price, l_extendedprice AS value, 100.0 / l_linenumber AS pct,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_director, o_orderpriority = '3-MEDIUM' AS is_officer,
         c_mktsegment = 'BUILDING' AS is_ten, l_tax >= 0.07 AS is_plan, l_orderkey * 10 + l_linenumber AS tx_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
buys AS (SELECT * FROM filings WHERE code = 'AO'),
sales AS (SELECT * FROM filings WHERE code = 'RF'),
bars AS (
  SELECT l_suppkey AS issuer, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS dollar_volume
  FROM lineitem GROUP BY ALL),
calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)),
benchmark AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS level FROM lineitem GROUP BY ALL)"""


def sql(body: str) -> str:
    """An oracle: ``body`` continues the list of CTEs (", x AS (...)") or begins with SELECT."""
    return f"WITH RECURSIVE {SQL.strip()}\n{body.strip()}"
