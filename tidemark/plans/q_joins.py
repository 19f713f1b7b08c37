"""As-of, positional, range and key joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import asof_backward, positional
from ..operators.rangejoin import range_join
from . import binding as B
from .q_clusters import EPISODES_SQL, episode_rows
from .registry import query

_FACTS = ", facts AS (SELECT o_custkey AS owner, CAST(o_orderdate AS DATE) AS fact_date, max(o_totalprice) AS amount FROM orders GROUP BY ALL)"


def _facts(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("date").alias("fact_date")).agg(F.max("o_totalprice").alias("amount"))


def _probes(spark, sf_dir):
    return B.buys(spark, sf_dir).select("tx_id", "owner", "tx_date")


@query("j01_score_join", B.sql(", s AS (SELECT l_suppkey AS issuer, CAST(l_shipdate AS DATE) AS event_day, max(l_discount) AS score FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) SELECT b.tx_id, round(s.score, 4) AS score FROM buys b LEFT JOIN s ON b.issuer = s.issuer AND b.tx_date = s.event_day"))
def j01_score_join(spark, sf_dir):
    scores = B.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("issuer"), F.col("l_shipdate").cast("date").alias("tx_date")).agg(F.max("l_discount").alias("score"))
    return B.buys(spark, sf_dir).join(scores, ["issuer", "tx_date"], "left").select("tx_id", F.round("score", 4).alias("score"))


@query("j02_price_lookup", B.sql("SELECT tx_id, round(close, 6) AS close FROM buys b LEFT JOIN bars p ON b.issuer = p.issuer AND b.filing_date = p.date"))
def j02_price_lookup(spark, sf_dir):
    bars = B.bars(spark, sf_dir).select("issuer", F.col("date").alias("filing_date"), "close")
    return B.buys(spark, sf_dir).join(bars, ["issuer", "filing_date"], "left").select("tx_id", F.round("close", 6).alias("close"))


@query("j03_asof_inclusive", B.sql("SELECT tx_id, p.date AS asof_date, round(close, 6) AS close FROM buys b ASOF LEFT JOIN bars p ON b.issuer = p.issuer AND b.filing_date >= p.date"))
def j03_asof_inclusive(spark, sf_dir):
    probes = B.buys(spark, sf_dir).select("tx_id", "issuer", "filing_date")
    return asof_backward(probes, B.bars(spark, sf_dir), by=["issuer"], probe_on="filing_date", fact_on="date", values=["close"]).select("tx_id", "asof_date", F.round("close", 6).alias("close"))


@query("j04_asof_strict", B.sql(_FACTS + " SELECT tx_id, fact_date AS asof_date, round(amount, 4) AS amount FROM buys b ASOF LEFT JOIN facts f ON b.owner = f.owner AND b.tx_date > f.fact_date"))
def j04_asof_strict(spark, sf_dir):
    return asof_backward(_probes(spark, sf_dir), _facts(spark, sf_dir), by=["owner"], probe_on="tx_date", fact_on="fact_date", values=["amount"], strict=True).select("tx_id", "asof_date", F.round("amount", 4).alias("amount"))


@query("j05_asof_lagged", B.sql(_FACTS + ", p AS (SELECT owner, fact_date, fact_date + 8 AS published, amount FROM facts) SELECT tx_id, round(amount, 4) AS amount, CAST(b.tx_date - p.fact_date AS INTEGER) AS stale_days FROM buys b ASOF LEFT JOIN p ON b.owner = p.owner AND b.tx_date > p.published"))
def j05_asof_lagged(spark, sf_dir):
    facts = _facts(spark, sf_dir).withColumn("published", F.date_add("fact_date", 8))
    found = asof_backward(_probes(spark, sf_dir), facts, by=["owner"], probe_on="tx_date", fact_on="published", values=["amount", "fact_date"], strict=True)
    return found.select("tx_id", F.round("amount", 4).alias("amount"), F.datediff("tx_date", "fact_date").alias("stale_days"))


@query("j06_asof_tolerance", B.sql(_FACTS + " SELECT tx_id, CASE WHEN b.tx_date - fact_date <= 14 THEN round(amount, 4) END AS amount FROM buys b ASOF LEFT JOIN facts f ON b.owner = f.owner AND b.tx_date >= f.fact_date"))
def j06_asof_tolerance(spark, sf_dir):
    found = asof_backward(_probes(spark, sf_dir), _facts(spark, sf_dir), by=["owner"], probe_on="tx_date", fact_on="fact_date", values=["amount"], tolerance=14)
    return found.select("tx_id", F.round("amount", 4).alias("amount"))


@query("j07_forward_bounded", B.sql(EPISODES_SQL + " SELECT e.issuer, e.event_day, min(p.date) AS entry_day FROM episodes e LEFT JOIN bars p ON p.issuer = e.issuer AND p.date > e.event_day AND p.date <= e.event_day + 5 GROUP BY ALL"))
def j07_forward_bounded(spark, sf_dir):
    found = asof_backward(episode_rows(spark, sf_dir), B.bars(spark, sf_dir), by=["issuer"], probe_on="event_day", fact_on="date", values=["open"], strict=True, forward=True, tolerance=5)
    return found.select("issuer", "event_day", F.col("asof_date").alias("entry_day"))


@query("j08_next_trading_day", B.sql("SELECT DISTINCT filing_date, (SELECT min(date) FROM calendar WHERE date > filing_date) AS next_day FROM buys"))
def j08_next_trading_day(spark, sf_dir):
    probes = B.buys(spark, sf_dir).select(F.lit(1).alias("k"), "filing_date").distinct()
    days = B.calendar(spark, sf_dir).withColumn("k", F.lit(1))  # the calendar has one row a trading day
    return asof_backward(probes, days, by=["k"], probe_on="filing_date", fact_on="date", values=["idx"], strict=True, forward=True).select("filing_date", F.col("asof_date").alias("next_day"))


@query("j09_positional", B.sql(EPISODES_SQL + " SELECT e.issuer, e.event_day, c.date AS exit_day FROM episodes e LEFT JOIN calendar c ON c.idx = e.idx + 63"))
def j09_positional(spark, sf_dir):
    return positional(episode_rows(spark, sf_dir), B.calendar(spark, sf_dir), idx="idx", offset=63, name="exit_day").select("issuer", "event_day", "exit_day")


@query("j11_range_visible", B.sql(EPISODES_SQL + """
SELECT e.issuer, e.event_day, count(*) AS n, count(DISTINCT s.owner) AS sellers, round(sum(s.value), 4) AS total FROM episodes e JOIN sales s ON s.issuer = e.issuer AND s.tx_date BETWEEN e.event_day - 13 AND e.event_day AND s.filing_date <= e.event_day GROUP BY ALL"""))
def j11_range_visible(spark, sf_dir):
    """Also A3, the sale window's statistics."""
    sales = B.of_code(spark, sf_dir, B.SALE).select("issuer", F.col("owner").alias("seller"), "tx_date", "filing_date", "value")
    pairs = range_join(episode_rows(spark, sf_dir), sales, by=["issuer"], probe_on="event_day", fact_on="tx_date", before=13, condition=F.col("filing_date") <= F.col("event_day"))
    return pairs.groupBy("issuer", "event_day").agg(F.count("*").alias("n"), F.countDistinct("seller").alias("sellers"), F.round(F.sum("value"), 4).alias("total"))


@query("j12_trailing_strict", B.sql(EPISODES_SQL + """
SELECT e.issuer, e.event_day, count(g.tx_id) AS n, round(coalesce(sum(g.value), 0), 4) AS total FROM episodes e LEFT JOIN filings g ON g.code = 'NO' AND g.issuer = e.issuer AND g.tx_date >= e.event_day - 180 AND g.tx_date < e.event_day AND g.filing_date < e.event_day GROUP BY ALL"""))
def j12_trailing_strict(spark, sf_dir):
    grants = B.of_code(spark, sf_dir, B.GRANT).select("issuer", "tx_date", "filing_date", "value", "tx_id")
    pairs = range_join(episode_rows(spark, sf_dir), grants, by=["issuer"], probe_on="event_day", fact_on="tx_date", before=180, after=-1, condition=F.col("filing_date") < F.col("event_day"), how="left")
    return pairs.groupBy("issuer", "event_day").agg(F.count("tx_id").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))


@query("j13_sale_after_exercise", B.sql("""
, x AS (SELECT tx_id, issuer, owner, tx_date FROM filings WHERE code = 'NF'),
m AS (SELECT x.tx_id, bool_or(s.tx_id IS NOT NULL) AS sold FROM x LEFT JOIN sales s ON s.issuer = x.issuer AND s.owner = x.owner AND s.tx_date BETWEEN x.tx_date AND x.tx_date + 5 GROUP BY ALL)
SELECT x.tx_id, CASE WHEN sold THEN true WHEN x.tx_date + 5 <= (SELECT max(date) FROM calendar) THEN false END AS sold FROM x JOIN m USING (tx_id)"""))
def j13_sale_after_exercise(spark, sf_dir):
    """Tri-state: unknown where the window runs past the data."""
    exercises = B.of_code(spark, sf_dir, B.EXERCISE).select("tx_id", "issuer", "owner", "tx_date")
    sales = B.of_code(spark, sf_dir, B.SALE).select("issuer", "owner", F.col("tx_date").alias("sale_date"), F.col("tx_id").alias("sale_id"))
    pairs = range_join(exercises, sales, by=["issuer", "owner"], probe_on="tx_date", fact_on="sale_date", before=0, after=5).select("tx_id").distinct().withColumn("hit", F.lit(True))
    last = B.calendar(spark, sf_dir).agg(F.max("date").alias("last"))
    joined = exercises.join(pairs, "tx_id", "left").crossJoin(F.broadcast(last))  # one row
    return joined.select("tx_id", F.when(F.col("hit"), True).when(F.date_add("tx_date", 5) <= F.col("last"), False).alias("sold"))


@query("j14_semi_anti", "SELECT s_suppkey AS issuer, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) AS has_large FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'X')")
def j14_semi_anti(spark, sf_dir):
    line = B.table(spark, sf_dir, "lineitem")
    large = line.filter("l_quantity >= 50").select(F.col("l_suppkey").alias("issuer")).distinct().withColumn("hit", F.lit(True))
    issuers = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("issuer"))
    kept = issuers.join(line.filter("l_returnflag = 'X'").select(F.col("l_suppkey").alias("issuer")), "issuer", "left_anti")
    return kept.join(large, "issuer", "left").select("issuer", F.col("hit").isNotNull().alias("has_large"))


@query("j15_without_prices", "SELECT c_custkey AS owner, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j15_without_prices(spark, sf_dir):
    filled = B.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return B.table(spark, sf_dir, "customer").join(filled, "c_custkey", "left_anti").select(F.col("c_custkey").alias("owner"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))


@query("j17_benchmark", B.sql(EPISODES_SQL + ", f AS (SELECT date, lead(level, 21) OVER (ORDER BY date) / level - 1 AS fwd FROM benchmark) SELECT issuer, event_day, round(fwd, 6) AS bench_21 FROM episodes LEFT JOIN f ON date = event_day"))
def j17_benchmark(spark, sf_dir):
    ahead = F.lead("level", 21).over(Window.orderBy("date"))  # one row a trading day
    returns = B.benchmark(spark, sf_dir).select(F.col("date").alias("event_day"), (ahead / F.col("level") - 1).alias("fwd"))
    return episode_rows(spark, sf_dir).join(F.broadcast(returns), "event_day", "left").select("issuer", "event_day", F.round("fwd", 6).alias("bench_21"))


@query("j18_snap", B.sql("SELECT DISTINCT filing_date, (SELECT min(date) FROM calendar WHERE date >= filing_date) AS snapped FROM sales"))
def j18_snap(spark, sf_dir):
    probes = B.of_code(spark, sf_dir, B.SALE).select(F.lit(1).alias("k"), "filing_date").distinct()
    days = B.calendar(spark, sf_dir).withColumn("k", F.lit(1))
    return asof_backward(probes, days, by=["k"], probe_on="filing_date", fact_on="date", values=["idx"], forward=True).select("filing_date", F.col("asof_date").alias("snapped"))


@query("j19_aligned_returns", B.sql(", r AS (SELECT issuer, date, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) - 1 AS ret FROM bars), m AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS bench FROM benchmark) SELECT issuer, date, round(ret, 6) AS ret, round(bench, 6) AS bench FROM r JOIN m USING (date) WHERE ret IS NOT NULL AND bench IS NOT NULL"))
def j19_aligned_returns(spark, sf_dir):
    """Every issuer's returns with the market's on the dates that both have."""
    from ..operators.windows import with_returns

    rets = with_returns(B.bars(spark, sf_dir)).filter("ret IS NOT NULL").select("issuer", "date", F.round("ret", 6).alias("ret"))
    before = F.lag("level").over(Window.orderBy("date"))  # one row a trading day
    bench = B.benchmark(spark, sf_dir).select("date", F.round(F.col("level") / before - 1, 6).alias("bench")).filter("bench IS NOT NULL")
    return rets.join(F.broadcast(bench), "date")


@query("j20_axis_offset", B.sql(", c AS (SELECT date, idx, CAST(date_diff('day', DATE '1995-01-01', date) AS BIGINT) AS axis FROM calendar), o AS (SELECT axis - idx AS shift, count(*) AS n FROM c GROUP BY ALL) SELECT shift, n, n >= 0.99 * (SELECT count(*) FROM c) AS agrees FROM o ORDER BY n DESC, shift LIMIT 1"))
def j20_axis_offset(spark, sf_dir):
    """The most frequent offset between an integer axis and the calendar, and whether 99 % agree."""
    rows = B.calendar(spark, sf_dir).select((F.datediff("date", F.lit("1995-01-01").cast("date")) - F.col("idx")).alias("shift"))
    counts = rows.groupBy("shift").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return counts.orderBy(F.desc("n"), "shift").limit(1).select("shift", "n", (F.col("n") >= 0.99 * F.col("total")).alias("agrees"))


@query("j21_variable_hold", B.sql(EPISODES_SQL + """
, t AS (SELECT issuer, event_day, idx, least(idx + 10 + issuer % 50, (SELECT max(idx) FROM calendar)) AS out FROM episodes),
l AS (SELECT idx, level FROM calendar JOIN benchmark USING (date))
SELECT issuer, event_day, round(b.level / a.level - 1, 6) AS bench FROM t JOIN l a ON a.idx = t.idx JOIN l b ON b.idx = t.out"""))
def j21_variable_hold(spark, sf_dir):
    levels = B.calendar(spark, sf_dir).join(B.benchmark(spark, sf_dir), "date").select("idx", "level")
    last = levels.agg(F.max("idx").alias("last"))
    trades = episode_rows(spark, sf_dir).crossJoin(F.broadcast(last)).withColumn("out", F.least(F.col("idx") + 10 + F.col("issuer") % 50, F.col("last")))
    ends = levels.select(F.col("idx").alias("out"), F.col("level").alias("end_level"))
    return trades.join(F.broadcast(levels), "idx").join(F.broadcast(ends), "out").select("issuer", "event_day", F.round(F.col("end_level") / F.col("level") - 1, 6).alias("bench"))


@query("j22_lag_to_calendar", B.sql("""
, obs AS (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-02' GROUP BY ALL),
placed AS (SELECT d, v, (SELECT min(idx) FROM calendar c WHERE c.date > d) + 2 AS idx FROM obs),
one AS (SELECT idx, arg_max(v, d) AS v FROM placed GROUP BY idx)
SELECT c.date, round(last_value(v IGNORE NULLS) OVER (ORDER BY c.idx), 4) AS value FROM calendar c LEFT JOIN one USING (idx)"""))
def j22_lag_to_calendar(spark, sf_dir):
    return _lagged(spark, sf_dir, B.table(spark, sf_dir, "orders"))


@query("j22_monthly_observations", B.sql("""
, obs AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS d, count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-02' GROUP BY ALL),
placed AS (SELECT d, v, (SELECT min(idx) FROM calendar c WHERE c.date > d) + 2 AS idx FROM obs),
one AS (SELECT idx, arg_max(v, d) AS v FROM placed GROUP BY idx)
SELECT c.date, last_value(v IGNORE NULLS) OVER (ORDER BY c.idx) AS value FROM calendar c LEFT JOIN one USING (idx)"""))
def j22_monthly_observations(spark, sf_dir):
    """A monthly series, so that most days are filled forward."""
    obs = B.table(spark, sf_dir, "orders").filter("o_orderdate >= '1995-01-02'").groupBy(F.last_day("o_orderdate").alias("d")).agg(F.count("*").alias("v"))
    return _placed(spark, sf_dir, obs)


def _lagged(spark, sf_dir, orders):
    obs = orders.filter("o_orderdate >= '1995-01-02'").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.max("o_totalprice").alias("v"))
    return _placed(spark, sf_dir, obs).withColumn("value", F.round("value", 4))


def _placed(spark, sf_dir, obs):
    """First trading day after the observation (d, v), plus lag - 1; the last observation of a day wins; filled forward."""
    obs = obs.withColumn("k", F.lit(1))
    days = B.calendar(spark, sf_dir)
    placed = asof_backward(obs, days.withColumn("k", F.lit(1)), by=["k"], probe_on="d", fact_on="date", values=["idx"], strict=True, forward=True)
    one = placed.groupBy((F.col("idx") + 2).alias("idx")).agg(F.max_by("v", "d").alias("v"))
    filled = F.last("v", ignorenulls=True).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(one, "idx", "left").select("date", filled.alias("value"))


@query("j23_tag_dictionary", "SELECT p_partkey AS part, g.grp, g.rank FROM part JOIN (VALUES ('PROMO', 'sales', 1), ('ECONOMY', 'cost', 2), ('STANDARD', 'cost', 1)) g(tag, grp, rank) ON split_part(p_type, ' ', 1) = g.tag")
def j23_tag_dictionary(spark, sf_dir):
    tags = spark.createDataFrame([("PROMO", "sales", 1), ("ECONOMY", "cost", 2), ("STANDARD", "cost", 1)], "tag string, grp string, rank int")
    return B.table(spark, sf_dir, "part").withColumn("tag", F.split_part("p_type", F.lit(" "), F.lit(1))).join(F.broadcast(tags), "tag").select(F.col("p_partkey").alias("part"), "grp", "rank")


@query("a27_first_appearance", B.sql(EPISODES_SQL + """
, first_seen AS (SELECT issuer, owner, min(filing_date) AS since FROM filings GROUP BY ALL)
SELECT e.issuer, e.event_day, count(f.owner) AS new_owners FROM episodes e LEFT JOIN first_seen f ON f.issuer = e.issuer AND f.since >= e.event_day - 365 AND f.since < e.event_day GROUP BY ALL"""))
def a27_first_appearance(spark, sf_dir):
    seen = B.filings(spark, sf_dir).groupBy("issuer", "owner").agg(F.min("filing_date").alias("since"))
    pairs = range_join(episode_rows(spark, sf_dir), seen, by=["issuer"], probe_on="event_day", fact_on="since", before=365, after=-1, how="left")
    return pairs.groupBy("issuer", "event_day").agg(F.count("owner").alias("new_owners"))
