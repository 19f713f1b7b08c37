"""Further feature sections, folds, reference ranks and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import windows as X
from ..operators.asof import asof_backward
from ..operators.rangejoin import range_join
from . import binding as B
from .q_clusters import EPISODES_SQL, episode_rows
from .registry import query

_SALES = EPISODES_SQL + """
, sold AS (SELECT e.issuer, e.event_day, count(s.tx_id) AS n, count(DISTINCT s.owner) AS sellers, coalesce(sum(s.value), 0) AS total FROM episodes e LEFT JOIN sales s ON s.issuer = e.issuer AND s.tx_date BETWEEN e.event_day - 89 AND e.event_day AND s.filing_date <= e.event_day GROUP BY ALL),
bought AS (SELECT e.issuer, e.event_day, sum(b.value) AS total FROM episodes e JOIN buys b ON b.issuer = e.issuer AND b.tx_date BETWEEN e.event_day - 13 AND e.event_day AND b.filing_date <= e.event_day GROUP BY ALL)"""


@query("d09_concurrent_selling", B.sql(_SALES + " SELECT s.issuer, s.event_day, s.n AS n_sales, s.sellers, round(s.total, 4) AS sold, round(s.total / nullif(b.total, 0), 6) AS sold_to_bought, s.n > 0 AS any_sale FROM sold s JOIN bought b USING (issuer, event_day)"))
def d09_concurrent_selling(spark, sf_dir):
    """Section F: visible sales of the last 90 days against the purchases."""
    episodes = episode_rows(spark, sf_dir)
    sales = B.of_code(spark, sf_dir, B.SALE).select("issuer", "tx_id", F.col("owner").alias("seller"), "tx_date", "filing_date", "value")
    seen = F.col("filing_date") <= F.col("event_day")
    sold = range_join(episodes, sales, by=["issuer"], probe_on="event_day", fact_on="tx_date", before=89, condition=seen, how="left").groupBy("issuer", "event_day").agg(F.count("tx_id").alias("n_sales"), F.countDistinct("seller").alias("sellers"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    bought = range_join(episodes, B.buys(spark, sf_dir).select("issuer", "tx_date", "filing_date", "value"), by=["issuer"], probe_on="event_day", fact_on="tx_date", before=13, condition=seen).groupBy("issuer", "event_day").agg(F.sum("value").alias("b"))
    return sold.join(bought, ["issuer", "event_day"]).select("issuer", "event_day", "n_sales", "sellers", F.round("s", 4).alias("sold"), F.round(F.try_divide("s", "b"), 6).alias("sold_to_bought"), (F.col("n_sales") > 0).alias("any_sale"))


@query("d11_filing_context", B.sql("""
, p AS (SELECT DISTINCT owner, tx_date FROM buys), f AS (SELECT o_custkey AS owner, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS form FROM orders)
SELECT p.owner, p.tx_date, count(f.d) FILTER (form = 'F') AS n_f, count(f.d) FILTER (form = 'O') AS n_o, CAST(p.tx_date - max(f.d) AS INTEGER) AS days_since FROM p LEFT JOIN f ON f.owner = p.owner AND f.d >= p.tx_date - 180 AND f.d < p.tx_date GROUP BY p.owner, p.tx_date"""))
def d11_filing_context(spark, sf_dir):
    """Counts by form and recency over the 180 days strictly before."""
    probes = B.buys(spark, sf_dir).select("owner", "tx_date").distinct()
    filings = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("form"))
    pairs = range_join(probes, filings, by=["owner"], probe_on="tx_date", fact_on="d", before=180, after=-1, how="left")
    return pairs.groupBy("owner", "tx_date").agg(F.count_if(F.col("form") == "F").alias("n_f"), F.count_if(F.col("form") == "O").alias("n_o"), F.max("d").alias("m")).select("owner", "tx_date", "n_f", "n_o", F.datediff("tx_date", "m").alias("days_since"))


@query("d12_fundamentals", B.sql("""
, f AS (SELECT o_custkey AS owner, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, max(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY ALL),
p AS (SELECT DISTINCT owner, tx_date FROM buys),
x AS (SELECT p.owner, p.tx_date, a FROM p ASOF LEFT JOIN (SELECT * FROM f WHERE a IS NOT NULL) g ON g.owner = p.owner AND p.tx_date > g.d), y AS (SELECT p.owner, p.tx_date, b FROM p ASOF LEFT JOIN (SELECT * FROM f WHERE b IS NOT NULL) g ON g.owner = p.owner AND p.tx_date > g.d)
SELECT owner, tx_date, round(ln(a), 6) AS log_a, round(ln(1 + b), 6) AS log1p_b, round(CASE WHEN a / b IS NOT NULL THEN least(a / b, 40) END, 6) AS ratio FROM x JOIN y USING (owner, tx_date)"""))
def d12_fundamentals(spark, sf_dir):
    """Two strict as-of facts by tag, then logs and a capped ratio."""
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice", (F.col("o_orderkey") % 2).alias("tag"))
    probes = B.buys(spark, sf_dir).select("owner", "tx_date").distinct()
    for tag, name in ((0, "a"), (1, "b")):
        facts = orders.filter(F.col("tag") == tag).groupBy("owner", "d").agg(F.max("o_totalprice").alias(name))
        probes = asof_backward(probes, facts, by=["owner"], probe_on="tx_date", fact_on="d", values=[name], strict=True).drop("asof_date")
    return probes.select("owner", "tx_date", F.round(F.log("a"), 6).alias("log_a"), F.round(F.log1p("b"), 6).alias("log1p_b"), F.round(F.when(F.try_divide("a", "b").isNotNull(), F.least(F.try_divide("a", "b"), F.lit(40.0))), 6).alias("ratio"))


@query("d14_short_interest", B.sql("""
, f AS (SELECT o_custkey AS owner, CAST(o_orderdate AS DATE) AS settled, max(o_totalprice) AS s FROM orders GROUP BY ALL),
g AS (SELECT *, settled + 8 AS published, lag(s) OVER (PARTITION BY owner ORDER BY settled) AS previous FROM f)
SELECT b.owner, b.tx_date, round(s, 4) AS short, round(s / nullif(previous, 0) - 1, 6) AS change, CAST(b.tx_date - settled AS INTEGER) AS age FROM (SELECT DISTINCT owner, tx_date FROM buys) b ASOF LEFT JOIN g ON g.owner = b.owner AND b.tx_date > g.published"""))
def d14_short_interest(spark, sf_dir):
    facts = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("date").alias("settled")).agg(F.max("o_totalprice").alias("short"))
    facts = facts.withColumn("previous", F.lag("short").over(Window.partitionBy("owner").orderBy("settled"))).withColumn("published", F.date_add("settled", 8))
    probes = B.buys(spark, sf_dir).select("owner", "tx_date").distinct()
    found = asof_backward(probes, facts, by=["owner"], probe_on="tx_date", fact_on="published", values=["short", "previous", "settled"], strict=True)
    return found.select("owner", "tx_date", F.round("short", 4).alias("short"), F.round(F.try_divide("short", "previous") - 1, 6).alias("change"), F.datediff("tx_date", "settled").alias("age"))


@query("w24_prior_return", B.sql(EPISODES_SQL + """
, r AS (SELECT e.issuer, e.event_day, e.idx, c.date AS closed, x.close / b.close - 1 AS ret FROM episodes e LEFT JOIN calendar c ON c.idx = e.idx + 63 LEFT JOIN bars b ON b.issuer = e.issuer AND b.date = e.event_day LEFT JOIN bars x ON x.issuer = e.issuer AND x.date = c.date)
SELECT a.issuer, a.event_day, count(p.event_day) AS n_prior, round(avg(p.ret), 6) AS mean_prior FROM r a LEFT JOIN r p ON p.issuer = a.issuer AND p.event_day < a.event_day AND p.closed < a.event_day GROUP BY ALL"""))
def w24_prior_return(spark, sf_dir):
    """Mean return of earlier episodes whose 63-day window is closed: running sums looked up as of the closing day, no pairs."""
    bars = B.bars(spark, sf_dir).select("issuer", "date", "close")
    opening, closing = bars.select("issuer", F.col("date").alias("event_day"), F.col("close").alias("c0")), bars.select("issuer", F.col("date").alias("closed"), F.col("close").alias("c1"))
    days = B.calendar(spark, sf_dir).select((F.col("idx") - 63).alias("idx"), F.col("date").alias("closed"))
    rows = episode_rows(spark, sf_dir).join(F.broadcast(days), "idx", "left").join(opening, ["issuer", "event_day"], "left").join(closing, ["issuer", "closed"], "left").withColumn("ret", F.try_divide("c1", "c0") - 1)
    past = Window.partitionBy("issuer").orderBy("closed").rangeBetween(Window.unboundedPreceding, 0)
    sums = rows.filter("closed IS NOT NULL").select("issuer", "closed", F.count("*").over(past).alias("n_prior"), F.sum("ret").over(past).alias("s"), F.count("ret").over(past).alias("k")).dropDuplicates(["issuer", "closed"])
    found = asof_backward(rows.select("issuer", "event_day"), sums, by=["issuer"], probe_on="event_day", fact_on="closed", values=["n_prior", "s", "k"], strict=True)
    return found.select("issuer", "event_day", F.coalesce("n_prior", F.lit(0)).alias("n_prior"), F.round(F.try_divide("s", "k"), 6).alias("mean_prior"))


@query("w25_span_pairs", B.sql(", s AS (SELECT o_custkey % 50 AS ticker, o_custkey AS cik, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY ALL) SELECT ticker, cik, lag(cik) OVER w AS previous, CAST(a - lag(b) OVER w AS INTEGER) AS gap FROM s WINDOW w AS (PARTITION BY ticker ORDER BY a, cik)"))
def w25_span_pairs(spark, sf_dir):
    """Adjacent identities of one ticker and the gap between them."""
    day = F.col("o_orderdate").cast("date")
    spans = B.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("ticker"), F.col("o_custkey").alias("cik")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    w = Window.partitionBy("ticker").orderBy("a", "cik")
    return spans.select("ticker", "cik", F.lag("cik").over(w).alias("previous"), F.datediff("a", F.lag("b").over(w)).alias("gap"))


@query("w26_chain_walk", B.sql(", s AS (SELECT o_custkey % 50 AS ticker, o_custkey AS cik, min(CAST(o_orderdate AS DATE)) AS a, o_custkey % 3 <> 0 AS is_rename FROM orders GROUP BY ALL) SELECT ticker, cik, bool_and(is_rename) OVER (PARTITION BY ticker ORDER BY a DESC, cik DESC ROWS UNBOUNDED PRECEDING) AS in_chain FROM s"))
def w26_chain_walk(spark, sf_dir):
    """From the newest span back: all is one chain until the first that is no rename."""
    spans = B.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("ticker"), F.col("o_custkey").alias("cik")).agg(F.min(F.col("o_orderdate").cast("date")).alias("a"))
    w = Window.partitionBy("ticker").orderBy(F.desc("a"), F.desc("cik")).rowsBetween(Window.unboundedPreceding, 0)
    return spans.select("ticker", "cik", F.bool_and(F.col("cik") % 3 != 0).over(w).alias("in_chain"))


@query("e11_unsafe_labels", B.sql(", nb AS (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY date) - 1 AS pos, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) AS ratio FROM bars), j AS (SELECT issuer, pos FROM nb WHERE ratio > 10 OR ratio < 0.1) SELECT DISTINCT n.issuer, n.date FROM nb n JOIN j ON j.issuer = n.issuer AND n.pos BETWEEN j.pos - 21 AND j.pos"))
def e11_unsafe_labels(spark, sf_dir):
    """Bars whose next 21 bars, or themselves, hold a jump: a forward frame, no join."""
    w = Window.partitionBy("issuer").orderBy("date")
    ratio = F.col("close") / F.lag("close").over(w)
    rows = B.bars(spark, sf_dir).withColumn("jump", (ratio > 10) | (ratio < 0.1))
    return rows.withColumn("near", F.max(F.coalesce(F.col("jump"), F.lit(False))).over(w.rowsBetween(0, 21))).filter("near").select("issuer", "date")


@query("e13_overrides", B.sql(", o AS (SELECT issuer, date, ratio, CASE WHEN issuer % 2 = 0 THEN ratio * 1.1 ELSE ratio * 1.3 END AS recorded FROM (SELECT issuer, date, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) AS ratio FROM bars) WHERE ratio >= 8) SELECT issuer, date, abs(ratio / recorded - 1) <= 0.15 AS applies FROM o"))
def e13_overrides(spark, sf_dir):
    """A recorded split is applied only if the observed ratio is within 15 % of it, so applying twice does nothing."""
    rows = X.discontinuities(B.bars(spark, sf_dir)).filter("ratio >= 8").withColumn("recorded", F.col("ratio") * F.when(F.col("issuer") % 2 == 0, 1.1).otherwise(1.3))
    return rows.select("issuer", "date", (F.abs(F.col("ratio") / F.col("recorded") - 1) <= 0.15).alias("applies"))


@query("m02_time_split", B.sql(EPISODES_SQL + ", r AS (SELECT issuer, event_day, row_number() OVER (ORDER BY event_day, issuer) AS k, count(*) OVER () AS n FROM episodes) SELECT issuer, event_day, k <= CAST(floor(n * 0.7) AS BIGINT) AS in_train FROM r"))
def m02_time_split(spark, sf_dir):
    """The first 70 % of episodes by day; episodes are few rows an issuer."""
    rows = episode_rows(spark, sf_dir).select("issuer", "event_day", F.row_number().over(Window.orderBy("event_day", "issuer")).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    return rows.select("issuer", "event_day", (F.col("k") <= F.floor(F.col("n") * 0.7)).alias("in_train"))


@query("m07_year_folds", B.sql(EPISODES_SQL + ", y AS (SELECT DISTINCT CAST(year(event_day) AS INTEGER) AS fold FROM episodes) SELECT fold, count(*) FILTER (year(event_day) = fold) AS test, count(*) FILTER (event_day + 96 < make_date(fold, 1, 1)) AS train FROM y, episodes GROUP BY fold"))
def m07_year_folds(spark, sf_dir):
    rows = episode_rows(spark, sf_dir)
    folds = F.broadcast(rows.select(F.year("event_day").alias("fold")).distinct())  # one row a year
    pairs = rows.join(folds, F.year("event_day") <= F.col("fold"))
    return pairs.groupBy("fold").agg(F.count_if(F.year("event_day") == F.col("fold")).alias("test"), F.count_if(F.date_add("event_day", 96) < F.make_date("fold", F.lit(1), F.lit(1))).alias("train"))


@query("m10_reference_percentile", B.sql(", ref AS (SELECT value FROM buys WHERE tx_date < DATE '1998-01-01'), probe AS (SELECT DISTINCT value FROM buys WHERE tx_date >= DATE '1998-01-01') SELECT round(p.value, 4) AS value, round((SELECT count(*) FROM ref WHERE ref.value <= p.value) / CAST((SELECT count(*) FROM ref) AS DOUBLE), 6) AS pct FROM probe p"))
def m10_reference_percentile(spark, sf_dir):
    """Share of a fixed reference at or below each value (search from the right); nothing is collected."""
    rows = B.buys(spark, sf_dir).select("value", (F.col("tx_date") < "1998-01-01").alias("is_ref"))
    both = S.counts_before(rows.groupBy("value").agg(F.count_if("is_ref").alias("k"), F.count_if(~F.col("is_ref")).alias("probes")), "value", "k")
    total = F.broadcast(rows.agg(F.count_if("is_ref").alias("all")))  # one row
    return both.filter("probes > 0").crossJoin(total).select(F.round("value", 4).alias("value"), F.round((F.col("before") + F.col("k")) / F.col("all"), 6).alias("pct"))


@query("v12_matched_excess", B.sql(", r AS (SELECT issuer, date, date_trunc('month', date)::DATE AS m, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) - 1 AS ret0, issuer % 5 AS bucket FROM bars), r2 AS (SELECT issuer, date, m, bucket, CASE WHEN ret0 IS NOT NULL THEN least(ret0, 1.0) END AS ret FROM r), b AS (SELECT m, bucket, avg(ret) AS base FROM r2 GROUP BY ALL) SELECT issuer, round(avg(ret - base), 6) AS excess FROM r2 JOIN b USING (m, bucket) WHERE ret IS NOT NULL GROUP BY issuer"))
def v12_matched_excess(spark, sf_dir):
    """Return over the mean of the month's bucket."""
    rows = X.with_returns(B.bars(spark, sf_dir)).filter("ret IS NOT NULL").select("issuer", F.trunc("date", "month").alias("m"), F.least("ret", F.lit(1.0)).alias("ret"), (F.col("issuer") % 5).alias("bucket"))
    base = rows.groupBy("m", "bucket").agg(F.avg("ret").alias("base"))
    return rows.join(base, ["m", "bucket"]).groupBy("issuer").agg(F.round(F.avg(F.col("ret") - F.col("base")), 6).alias("excess"))


@query("src01_fixed_width", "SELECT o_orderkey AS filing, CASE WHEN o_orderkey % 3 = 0 THEN '4/A' ELSE '4' END AS form, o_custkey AS cik, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderkey % 5 <> 0")
def src01_fixed_width(spark, sf_dir):
    """Index lines of fixed width: a form column, then the last three tokens from the right; other forms go."""
    from ..sources.indexes import parse_index_lines

    o = B.table(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderkey") % 5 == 0, "10-K").when(F.col("o_orderkey") % 3 == 0, "4/A").otherwise("4")
    lines = o.select(F.concat(F.rpad(form, 12, " "), F.rpad(F.lit("Some Issuer  Inc"), 62, " "), F.col("o_custkey").cast("string"), F.lit("   "), F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd"), F.lit("  data/"), F.col("o_orderkey").cast("string"), F.lit(".txt  ")).alias("value"))
    found = parse_index_lines(lines)
    return found.select(F.regexp_extract("file_name", r"([0-9]+)\.txt$", 1).cast("bigint").alias("filing"), "form", F.col("cik").cast("bigint").alias("cik"), "filed")


@query("src07_json_filings", B.sql("SELECT tx_id, owner, shares, filing_date FROM sales"))
def src07_json_filings(spark, sf_dir):
    """Nested filings as JSON text: transactions inlined, code and disposal filtered, dates in both formats."""
    from ..sources.filings import sale_rows

    rows = B.filings(spark, sf_dir).withColumn("t", F.struct(F.col("tx_id"), F.when(F.col("code") == B.SALE, "S").otherwise("P").alias("code"), F.when(F.col("code") == B.SALE, "D").otherwise("A").alias("disposed"), F.col("shares")))
    filed = F.when(F.col("tx_id") % 2 == 0, F.date_format("filing_date", "yyyyMMdd")).otherwise(F.date_format("filing_date", "yyyy-MM-dd"))
    docs = rows.select(F.to_json(F.struct(filed.alias("filing_date"), F.col("owner"), F.array("t").alias("transactions"))).alias("value"))
    return sale_rows(docs)


@query("src15_sentinels", "SELECT c_custkey AS symbol, CASE WHEN abs(c_acctbal - round(c_acctbal / 100, 0) * 100) < 1 THEN NULL ELSE round(c_acctbal, 4) END AS days FROM customer")
def src15_sentinels(spark, sf_dir):
    """Sentinel values within a tolerance become null."""
    gap = F.abs(F.col("c_acctbal") - F.round(F.col("c_acctbal") / 100, 0) * 100)
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.when(gap < 1, None).otherwise(F.round("c_acctbal", 4)).alias("days"))


@query("src11_bar_merge", B.sql("""
, old AS (SELECT issuer, date, close FROM bars WHERE date <= DATE '1999-06-30'), new AS (SELECT issuer, date, CASE WHEN issuer % 2 = 0 THEN close * 2 ELSE close * 1.01 END AS close FROM bars WHERE date >= DATE '1999-01-01'),
k AS (SELECT o.issuer, median(n.close / o.close) AS ratio FROM old o JOIN new n USING (issuer, date) GROUP BY o.issuer)
SELECT issuer, date, round(ln(CASE WHEN abs(ratio - 1) <= 0.02 THEN coalesce(o.close, n.close) ELSE coalesce(n.close, o.close * ratio) END), 6) AS ln_close FROM old o FULL JOIN new n USING (issuer, date) JOIN k USING (issuer)"""))
def src11_bar_merge(spark, sf_dir):
    """Overlap ratio by median: within 2 % the stored bars win, else stale rows are rescaled."""
    from ..sources.filings import merge_bars

    bars = B.bars(spark, sf_dir).select("issuer", "date", "close")
    old, new = bars.filter("date <= '1999-06-30'"), bars.filter("date >= '1999-01-01'")
    new = new.withColumn("close", F.when(F.col("issuer") % 2 == 0, F.col("close") * 2).otherwise(F.col("close") * 1.01))
    return merge_bars(old, new).select("issuer", "date", F.round(F.log("close"), 6).alias("ln_close"))


@query("s08_w11_sampled", B.sql(", s AS (SELECT issuer, sum(value) AS v FROM buys GROUP BY issuer), r AS (SELECT *, row_number() OVER (ORDER BY v, issuer) AS lo, row_number() OVER (ORDER BY v DESC, issuer) AS hi FROM s) SELECT issuer, round(v, 4) AS v FROM r WHERE lo <= 3 OR hi <= 3 OR issuer % 10 = 0"))
def s08_w11_sampled(spark, sf_dir):
    """A sample with the extremes forced in; sums of one order or another are alike, as they are rounded before they are compared."""
    totals = B.buys(spark, sf_dir).groupBy("issuer").agg(F.round(F.sum("value"), 4).alias("v"))
    low, high = totals.orderBy("v", "issuer").limit(3), totals.orderBy(F.desc("v"), "issuer").limit(3)
    return totals.filter("issuer % 10 = 0").union(low).union(high).dropDuplicates(["issuer"])


