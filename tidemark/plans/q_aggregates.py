"""Further aggregates and quality rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from . import binding as B
from .registry import query


@query("a10_score_buckets", B.sql(", s AS (SELECT issuer, CAST(count(*) % 7 AS BIGINT) - 2 AS score, sum(value) / 1e6 AS y FROM buys GROUP BY issuer, tx_date) SELECT CASE WHEN score < 0 THEN '<0' WHEN score >= 4 THEN '4+' ELSE CAST(score AS VARCHAR) END AS bucket, count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS mid, round(avg(CASE WHEN y > 0.03 THEN 1.0 ELSE 0.0 END), 6) AS win FROM s GROUP BY ALL"))
def a10_score_buckets(spark, sf_dir):
    rows = B.buys(spark, sf_dir).groupBy("issuer", "tx_date").agg((F.count("*") % 7 - 2).alias("score"), (F.sum("value") / 1e6).alias("y"))
    bucket = F.when(F.col("score") < 0, "<0").when(F.col("score") >= 4, "4+").otherwise(F.col("score").cast("string"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.median("y"), 6).alias("mid"), F.round(F.avg((F.col("y") > 0.03).cast("double")), 6).alias("win"))


@query("a20_box", B.sql("""
, q AS (SELECT issuer, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3, stddev_pop(value) AS sd FROM buys GROUP BY issuer)
SELECT issuer, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, round(sd, 4) AS sd, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 4) AS low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 4) AS high FROM q JOIN buys USING (issuer) GROUP BY issuer, q1, q2, q3, sd"""))
def a20_box(spark, sf_dir):
    """Linear quartiles and Tukey fences: the extreme values that are no outliers."""
    rows = B.buys(spark, sf_dir)
    q = rows.groupBy("issuer").agg(F.percentile("value", F.lit([0.25, 0.5, 0.75])).alias("q"), F.stddev_pop("value").alias("sd"))
    both = rows.join(q, "issuer")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    fences = both.groupBy("issuer").agg(F.min(F.when(F.col("value") >= F.col("q")[0] - reach, F.col("value"))).alias("low"), F.max(F.when(F.col("value") <= F.col("q")[2] + reach, F.col("value"))).alias("high"))
    return q.join(fences, "issuer").select("issuer", *[F.round(F.col("q")[k], 4).alias(f"q{k + 1}") for k in range(3)], F.round("sd", 4).alias("sd"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("a23_definition_sweep", B.sql("""
, c AS (SELECT issuer, tx_date, count(DISTINCT owner) AS n, sum(value) AS v, bool_or(is_officer) AS o FROM buys GROUP BY ALL),
g AS (SELECT k, p, r FROM (SELECT unnest([1, 2]) AS k), (SELECT unnest([0, 30000, 60000]) AS p), (SELECT unnest([false, true]) AS r))
SELECT k, p, r, count(c.n) AS n, round(avg(v), 4) AS mean, count(c.n) >= 300 AS enough FROM g LEFT JOIN c ON c.n >= k AND c.v >= p AND (NOT r OR c.o) GROUP BY ALL"""))
def a23_definition_sweep(spark, sf_dir):
    """Build once, mask for each definition: the definitions are a short literal list."""
    rows = B.buys(spark, sf_dir).groupBy("issuer", "tx_date").agg(F.countDistinct("owner").alias("n"), F.sum("value").alias("v"), F.bool_or("is_officer").alias("o"))
    definitions = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(r).alias("r")) for k in (1, 2) for p in (0, 30_000, 60_000) for r in (False, True)])
    each = rows.select("n", "v", "o", F.explode(definitions).alias("d")).select("n", "v", "o", "d.*")
    keep = (F.col("n") >= F.col("k")) & (F.col("v") >= F.col("p")) & (~F.col("r") | F.col("o"))
    return each.groupBy("k", "p", "r").agg(F.count_if(keep).alias("n"), F.round(F.avg(F.when(keep, F.col("v"))), 4).alias("mean")).withColumn("enough", F.col("n") >= 300)


@query("a24_time_split", B.sql(", t AS (SELECT issuer, tx_date, value, median(unix_day) OVER () AS mid, unix_day FROM (SELECT *, tx_date - DATE '1970-01-01' AS unix_day FROM buys)) SELECT unix_day <= mid AS early, count(*) AS n, round(avg(value), 4) AS mean FROM t GROUP BY ALL"))
def a24_time_split(spark, sf_dir):
    rows = B.buys(spark, sf_dir).withColumn("d", F.unix_date("tx_date"))
    mid = rows.agg(F.median("d").alias("mid"))  # one row
    return rows.crossJoin(F.broadcast(mid)).groupBy((F.col("d") <= F.col("mid")).alias("early")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("a25_a26_facts", B.sql(", f AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS v, o_orderkey % 3 AS rank, o_orderkey % 4 + 1 AS qtrs FROM orders) SELECT cik, filed, round(v * 4 / qtrs, 4) AS annual FROM (SELECT *, row_number() OVER (PARTITION BY cik, filed ORDER BY rank, qtrs DESC, v DESC) AS k FROM f) WHERE k = 1"))
def a25_a26_facts(spark, sf_dir):
    """Of each filing the lowest rank, then the longest period, then the largest value; flows annualised."""
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 3).alias("rank"), (F.col("o_orderkey") % 4 + 1).alias("qtrs"))
    best = rows.groupBy("cik", "filed").agg(F.min(F.struct("rank", (-F.col("qtrs")).alias("q"), (-F.col("v")).alias("w"))).alias("b"))
    return best.select("cik", "filed", F.round(-F.col("b.w") * 4 / -F.col("b.q"), 4).alias("annual"))


@query("e15_price_coverage", B.sql("SELECT count(*) AS wanted, count(*) FILTER (p.date IS NULL) AS missing, round(count(*) FILTER (p.date IS NOT NULL) / CAST(count(*) AS DOUBLE), 6) AS share FROM (SELECT DISTINCT issuer, filing_date FROM buys) b LEFT JOIN bars p ON p.issuer = b.issuer AND p.date = b.filing_date"))
def e15_price_coverage(spark, sf_dir):
    wanted = B.buys(spark, sf_dir).select("issuer", F.col("filing_date").alias("date")).distinct()
    have = B.bars(spark, sf_dir).select("issuer", "date", F.lit(True).alias("hit"))
    return wanted.join(have, ["issuer", "date"], "left").agg(F.count("*").alias("wanted"), F.count_if(F.col("hit").isNull()).alias("missing"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


@query("s04_precision_at_k", B.sql(", s AS (SELECT issuer, date_trunc('year', tx_date)::DATE AS y, sum(value) AS v, count(DISTINCT owner) >= 15 AS hit FROM buys GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, issuer) AS k FROM s) SELECT y, CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (k <= 20), 6) END AS precision_20, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS base FROM r GROUP BY y"))
def s04_precision_at_k(spark, sf_dir):
    rows = B.buys(spark, sf_dir).groupBy("issuer", F.trunc("tx_date", "year").alias("y")).agg(F.sum("value").alias("v"), (F.countDistinct("owner") >= 15).cast("double").alias("hit"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("v"), "issuer")))
    return ranked.groupBy("y").agg(F.round(F.when(F.count("*") >= 20, F.avg(F.when(F.col("k") <= 20, F.col("hit")))), 6).alias("precision_20"), F.round(F.avg("hit"), 6).alias("base"))


@query("a11_quintiles", B.sql(f", s AS (SELECT issuer, sum(value) AS x, avg(pct) AS y FROM buys GROUP BY issuer), edges AS (SELECT [{', '.join(f'quantile_cont(x, {k / 5!r})' for k in range(6))}] AS es FROM s) SELECT CAST(greatest(len(list_filter(list_distinct(es), lambda e: e < x)) - 1, 0) AS INTEGER) AS bucket, count(*) AS n, round(avg(y), 6) AS mean FROM s, edges GROUP BY ALL"))
def a11_quintiles(spark, sf_dir):
    rows = B.buys(spark, sf_dir).groupBy("issuer").agg(F.sum("value").alias("x"), F.avg("pct").alias("y"))
    return S.qcut(rows, "x", 5, []).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"))
