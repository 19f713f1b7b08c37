"""Ticker reuse, run selection, factor readings, capacity tables and small sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import finance
from ..operators import reuse as R
from ..operators.stats import medians
from ..sources.indexes import missing_weekdays, pick_document
from ..sources.scratch import written
from . import binding as B
from .registry import query


def _identities(spark, sf_dir):
    """Orders as filings: the customer files under a ticker that others used before; names carry corporate endings."""
    orders, customer = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "customer")
    ending = F.element_at(F.array(F.lit(" Corp"), F.lit(" Holdings Inc"), F.lit(" Trust /DE/")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), F.col("o_custkey").alias("cik"), F.concat("c_name", ending).alias("name"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("id"))


@query("e07_ticker_reuse")
def e07_ticker_reuse(spark, sf_dir):
    """E7, F8; the similarity has no SQL form, tests compare it with the matcher and the rules by hand."""
    return R.transitions(_identities(spark, sf_dir)).select("ticker", "cik_a", "cik_b", "gap", "similarity", "prior_identity", "kind")


@query("e08_safe_events")
def e08_safe_events(spark, sf_dir):
    """What is left for each ticker after unsafe spans go."""
    return R.safe_events(_identities(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n"), F.countDistinct("cik").alias("identities"))


@query("s06_top_runs", B.sql(", r AS (SELECT issuer, CASE WHEN count(ret) >= 300 THEN avg(ret) / stddev_samp(ret) END AS sharpe, CASE WHEN issuer % 9 <> 0 THEN sum(ret) END AS total FROM (SELECT issuer, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) - 1 AS ret FROM bars) GROUP BY issuer) SELECT issuer, round(coalesce(sharpe, total), 6) AS metric FROM r ORDER BY coalesce(sharpe, total, '-infinity'::DOUBLE) DESC, issuer LIMIT 25"))
def s06_top_runs(spark, sf_dir):
    """The best 25 runs by Sharpe, else by total return, else last."""
    from ..operators.windows import with_returns

    rows = with_returns(B.bars(spark, sf_dir)).groupBy("issuer").agg(F.when(F.count("ret") >= 300, F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"), F.when(F.col("issuer") % 9 != 0, F.sum("ret")).alias("total"))
    metric = F.coalesce("sharpe", "total")
    return rows.withColumn("metric", metric).orderBy(F.coalesce("metric", F.lit(float("-inf"))).desc(), "issuer").limit(25).select("issuer", F.round("metric", 6).alias("metric"))


@query("p18_factor_reading", B.sql(", r AS (SELECT issuer, date, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) - 1 AS ret FROM bars), u AS (SELECT issuer, date, 'momentum' AS factor, ret AS v FROM r UNION ALL SELECT issuer, date, 'drawdown', ret FROM r UNION ALL SELECT issuer, date, 'volume', ret FROM r) SELECT issuer, date, factor, CASE WHEN v IS NULL THEN NULL WHEN factor = 'momentum' THEN v > 0 WHEN factor = 'drawdown' THEN v <= 0 END AS favorable FROM u"))
def p18_factor_reading(spark, sf_dir):
    """Which side of zero a factor is on; null where it has no such pivot or no value."""
    from ..operators.windows import with_returns

    rows = with_returns(B.bars(spark, sf_dir)).select("issuer", "date", "ret", F.explode(F.array(F.lit("momentum"), F.lit("drawdown"), F.lit("volume"))).alias("factor"))
    reading = F.when(F.col("factor") == "momentum", F.col("ret") > 0).when(F.col("factor") == "drawdown", F.col("ret") <= 0)
    return rows.select("issuer", "date", "factor", F.when(F.col("ret").isNotNull(), reading).alias("favorable"))


@query("a30_capacity_and_cost", B.sql("""
, x AS (SELECT dollar_volume AS dv, open, greatest(5.0, least(400.0, 4 / sqrt(open) + 20 / sqrt(dollar_volume / 1e6))) + 2 * 200 * sqrt(10000 / dollar_volume) AS cost, ntile(10) OVER (ORDER BY open, issuer, date) AS decile FROM bars)
SELECT 'capacity ' || capital || '/' || days AS name, count(*) FILTER (dv * 0.1 * days >= capital) AS n, CAST(NULL AS DOUBLE) AS value FROM x, (SELECT unnest([10000, 100000, 1000000]) AS capital), (SELECT unnest([1, 3]) AS days) GROUP BY ALL
UNION ALL SELECT 'median cost', count(*), round(median(cost), 4) FROM x"""))
def a30_capacity_and_cost(spark, sf_dir):
    """Bars that fill a position of some capital in some days, and the median cost."""
    bars = written(B.bars(spark, sf_dir, together=True).select("dollar_volume", finance.cost_bps(F.col("open"), F.col("dollar_volume"), F.lit(10_000.0)).alias("cost")), "costs")
    sizes = [(c, d) for c in (10_000, 100_000, 1_000_000) for d in (1, 3)]
    counts = bars.agg(*[F.count_if(F.col("dollar_volume") * 0.1 * d >= c).alias(f"capacity {c}/{d}") for c, d in sizes])
    filled = counts.unpivot([], [f"`capacity {c}/{d}`" for c, d in sizes], "name", "n").select("name", "n", F.lit(None).cast("double").alias("value"))
    cost = bars.agg(F.count("*").alias("n")).join(F.broadcast(medians(bars, "cost", [])), F.lit(True), "left")  # one row each
    return filled.unionByName(cost.select(F.lit("median cost").alias("name"), "n", F.round("median", 4).alias("value")))


@query("a29_pool_reference", B.sql(", r AS (SELECT lead(close, 21) OVER (PARTITION BY issuer ORDER BY date) / close - 1 AS y FROM bars) SELECT count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS mid, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(power(1 + median(y), 12) - 1, 6) AS yearly, round(avg(y / greatest(abs(y), 0.10)), 6) AS label FROM r WHERE y IS NOT NULL"))
def a29_pool_reference(spark, sf_dir):
    """A29 with F4 (annualised) and F5 (the value over volatility, 0.10 at least)."""
    w = Window.partitionBy("issuer").orderBy("date")
    y = F.col("y")
    rows = written(B.bars(spark, sf_dir, together=True).select((F.lead("close", 21).over(w) / F.col("close") - 1).alias("y")).filter("y IS NOT NULL"), "pool")
    facts = rows.agg(F.count("*").alias("n"), F.round(F.avg(y), 6).alias("mean"), F.round(F.avg((y > 0).cast("double")), 6).alias("win"), F.round(F.avg(finance.sharpe_label(y, F.abs(y))), 6).alias("label"))
    both = facts.join(F.broadcast(medians(rows, "y", [])), F.lit(True), "left")  # one row each
    return both.select("n", "mean", F.round("median", 6).alias("mid"), "win", F.round(finance.annualise(F.col("median"), 12), 6).alias("yearly"), "label")


@query("f10_calendar_days", "SELECT h, CAST(round(h * 365.25 / 252) AS INTEGER) AS days FROM (SELECT unnest([10, 21, 63, 126, 252]) AS h)")
def f10_calendar_days(spark, sf_dir):
    """a horizon of trading days in calendar days."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in (10, 21, 63, 126, 252)])).alias("h")).select("h", F.round(F.col("h") * 365.25 / 252).cast("int").alias("days"))


@query("src02_missing_weekdays", B.sql("SELECT d::DATE AS day FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND d::DATE NOT IN (SELECT filing_date FROM sales WHERE issuer <= 3)"))
def src02_missing_weekdays(spark, sf_dir):
    """SRC2: weekdays that an index lacks; the index is that of three issuers' sales."""
    days = B.of_code(spark, sf_dir, B.SALE).filter("issuer <= 3").select(F.col("filing_date").alias("day"))
    return missing_weekdays(days, "1995-01-01", "1999-12-31")


@query("src04_pick_document", """
WITH f AS (SELECT o_custkey AS filing, CASE o_orderkey % 7 WHEN 0 THEN 'R' || (o_orderkey % 50) || '.xml' WHEN 1 THEN 'FilingSummary.xml' WHEN 2 THEN 'wf-form4_' || o_orderkey || '.xml' WHEN 3 THEN 'doc' || o_orderkey || '.xml' WHEN 4 THEN 'Primary_Doc.xml' WHEN 5 THEN 'page.html' ELSE 'xform3x' || o_orderkey || '.XML' END AS name, o_orderkey AS place FROM orders),
c AS (SELECT filing, name, place, lower(name) AS l FROM f WHERE lower(name) LIKE '%.xml' AND lower(name) NOT IN ('filingsummary.xml', 'metadata.xml') AND NOT regexp_full_match(lower(name), 'r[0-9]+\\.xml')),
r AS (SELECT *, CASE WHEN l = 'primary_doc.xml' THEN 0 WHEN regexp_matches(l, 'form[345]') OR l LIKE 'wf-form%' THEN 4 ELSE 5 END AS k FROM c)
SELECT filing, name FROM (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY k, place) AS n FROM r) WHERE n = 1""")
def src04_pick_document(spark, sf_dir):
    """SRC4: the ownership document among a filing's files."""
    key = F.col("o_orderkey").cast("string")
    kinds = [F.concat(F.lit("R"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".xml")), F.lit("FilingSummary.xml"), F.concat(F.lit("wf-form4_"), key, F.lit(".xml")), F.concat(F.lit("doc"), key, F.lit(".xml")), F.lit("Primary_Doc.xml"), F.lit("page.html"), F.concat(F.lit("xform3x"), key, F.lit(".XML"))]
    files = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("filing"), F.element_at(F.array(*kinds), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("name"), F.col("o_orderkey").alias("place"))
    return pick_document(files)
