"""Window features over bars, calendars and filings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import windows as X
from . import binding as B
from .registry import query

_BY = "WINDOW w AS (PARTITION BY issuer ORDER BY date)"
_RET = ", rets AS (SELECT *, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) - 1 AS ret FROM bars)"


def _r(c, name=None):
    return F.round(c, 4).alias(name or c)


@query("src10_bars", B.sql("SELECT issuer, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume, round(dollar_volume, 4) AS dollar_volume FROM bars"))
def src10_bars(spark, sf_dir):
    return B.bars(spark, sf_dir).select("issuer", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], _r("volume"), _r("dollar_volume"))


@query("w01_trailing_median", B.sql("""
, m AS (SELECT issuer, date, list_sort(list(dollar_volume) OVER f) AS d, list_sort(list(volume) OVER f) AS v FROM bars WINDOW f AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT issuer, date, round(d[len(d) // 2 + 1], 4) AS adv, round(v[len(v) // 2 + 1], 4) AS advol FROM m"""))
def w01_trailing_median(spark, sf_dir):
    """Also A4, the upper median."""
    return B.bars(spark, sf_dir).select("issuer", "date", F.round(X.trailing_median("dollar_volume"), 4).alias("adv"), F.round(X.trailing_median("volume"), 4).alias("advol"))


@query("w02_price_signals", B.sql(_RET + """
, f AS (SELECT issuer, date, lag(close, 1) OVER w / lag(close, 21) OVER w - 1 AS m, stddev_samp(ret) OVER v * sqrt(252) AS vol, count(close) OVER c AS n, lag(close, 1) OVER w / max(high) OVER h - 1 AS fh FROM rets
  WINDOW w AS (PARTITION BY issuer ORDER BY date), v AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN 31 PRECEDING AND 1 PRECEDING),
         h AS (PARTITION BY issuer ORDER BY date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT issuer, date, round(m, 4) AS momentum_20, round(CASE WHEN n >= 11 THEN vol END, 4) AS vol_30, round(fh, 4) AS from_high_90 FROM f"""))
def w02_price_signals(spark, sf_dir):
    return X.price_signals(B.bars(spark, sf_dir)).select("issuer", "date", _r("momentum_20"), _r("vol_30"), _r("from_high_90"))


@query("w03_06_price_context", B.sql(_RET + """
, f AS (SELECT issuer, date, CASE WHEN count(close) OVER d = 60 THEN lag(close) OVER w / max(close) OVER d - 1 END AS dd, lag(close, 6) OVER w / lag(close, 26) OVER w - 1 AS ms,
  CASE WHEN count(ret) OVER v = 63 THEN stddev_samp(ret) OVER v * sqrt(252) END AS vol, CASE WHEN count(close) OVER s = 200 THEN lag(close) OVER w / avg(close) OVER s END AS sma FROM rets
  WINDOW w AS (PARTITION BY issuer ORDER BY date), d AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING), s AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
SELECT issuer, date, round(dd, 4) AS drawdown_60, round(ms, 4) AS momentum_skip_20, round(vol, 4) AS vol_63, round(sma, 4) AS to_sma_200 FROM f"""))
def w03_06_price_context(spark, sf_dir):
    bars = X.with_returns(B.bars(spark, sf_dir))
    return bars.select("issuer", "date", F.round(X.drawdown(60), 4).alias("drawdown_60"), F.round(X.momentum_skip(20), 4).alias("momentum_skip_20"), F.round(X.annual_volatility(63), 4).alias("vol_63"), F.round(X.to_average(200), 4).alias("to_sma_200"))


_SCORES = ", scored AS (SELECT issuer, tx_date AS date, idx, sum(value) AS score FROM buys JOIN calendar ON tx_date = date GROUP BY ALL)"


def _scored(spark, sf_dir):
    """A score for each issuer and day: rounded so that average ranks meet no float noise."""
    totals = B.buys(spark, sf_dir).groupBy("issuer", F.col("tx_date").alias("date")).agg(F.round(F.sum("value"), 4).alias("score"))
    return totals.join(F.broadcast(B.calendar(spark, sf_dir)), "date")


@query("w07_period", B.sql(_SCORES + " SELECT issuer, date, CAST((idx - (SELECT min(idx) FROM scored)) // 21 AS BIGINT) AS period FROM scored"))
def w07_period(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.crossJoin(F.broadcast(rows.agg(F.min("idx").alias("low")))).select("issuer", "date", F.floor((F.col("idx") - F.col("low")) / 21).alias("period"))


_PERIOD_RANK = _SCORES + """
, periods AS (SELECT *, idx // 21 AS period FROM scored),
ranked AS (SELECT *, (rank() OVER (PARTITION BY period ORDER BY score) + (count(*) OVER (PARTITION BY period, score) - 1) / 2.0) / count(*) OVER (PARTITION BY period) AS r FROM periods)"""


def _ranked(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("period", F.floor(F.col("idx") / 21))
    return rows.withColumn("r", S.percent_rank_average("score", ["period"]))


@query("w08_rank_band", B.sql(_PERIOD_RANK + " SELECT issuer, date, CAST(period AS BIGINT) AS period, round(r, 6) AS r FROM ranked WHERE r > 0.7 AND r <= 0.9"))
def w08_rank_band(spark, sf_dir):
    """Average-tie percentile rank inside a period, then the band lo < r <= hi (also P10)."""
    return _ranked(spark, sf_dir).filter("r > 0.7 AND r <= 0.9").select("issuer", "date", "period", F.round("r", 6).alias("r"))


@query("w08b_rank_positional", B.sql(_PERIOD_RANK + " SELECT issuer, date, round(row_number() OVER (PARTITION BY period ORDER BY score, issuer, date) / CAST(count(*) OVER (PARTITION BY period) AS DOUBLE), 6) AS r FROM periods"))
def w08b_rank_positional(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("period", F.floor(F.col("idx") / 21))
    place = F.row_number().over(Window.partitionBy("period").orderBy("score", "issuer", "date"))
    return rows.select("issuer", "date", F.round(place / F.count("*").over(Window.partitionBy("period")), 6).alias("r"))


_QCUT = """
, edges AS (SELECT {by} AS g, list_distinct([{q}]) AS es FROM {t} GROUP BY ALL)"""


def _edges(value: str, bins: int) -> str:
    return ", ".join(f"quantile_cont({value}, {k / bins!r})" for k in range(bins + 1))


@query("w09_qcut", B.sql(_PERIOD_RANK + f"""
, edges AS (SELECT period, [{_edges('score', 10)}] AS es FROM periods GROUP BY period)
SELECT issuer, date, CAST(greatest(len(list_filter(list_distinct(es), lambda e: e < score)) - 1, 0) AS INTEGER) AS bucket FROM periods JOIN edges USING (period)"""))
def w09_qcut(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("period", F.floor(F.col("idx") / 21))
    return S.qcut(rows, "score", 10, ["period"]).select("issuer", "date", "bucket")


@query("w10_volatility_bucket", B.sql(_RET + f"""
, v AS (SELECT issuer, date, date_trunc('month', date) AS m, stddev_samp(ret) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS vol FROM rets),
edges AS (SELECT m, [{_edges('vol', 5)}] AS es FROM v GROUP BY m)
SELECT issuer, date, CASE WHEN vol IS NULL THEN -1 ELSE CAST(greatest(len(list_filter(list_distinct(es), lambda e: e < vol)) - 1, 0) AS INTEGER) END AS bucket FROM v JOIN edges USING (m)"""))
def w10_volatility_bucket(spark, sf_dir):
    """Within-month quintile of volatility, null to -1; also A32's input."""
    rows = X.with_returns(B.bars(spark, sf_dir)).select("issuer", "date", F.trunc("date", "month").alias("m"), F.stddev_samp("ret").over(S.trailing("issuer", "date", 30)).alias("vol"))
    return S.qcut(rows, "vol", 5, ["m"]).select("issuer", "date", F.coalesce("bucket", F.lit(-1)).alias("bucket"))


@query("w11_cohort_demean", B.sql(_SCORES + " SELECT issuer, date, round(score - median(score) OVER (PARTITION BY date_trunc('month', date)), 4) AS excess FROM scored"))
def w11_cohort_demean(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("m", F.trunc("date", "month"))
    return rows.join(rows.groupBy("m").agg(F.median("score").alias("mid")), "m").select("issuer", "date", F.round(F.col("score") - F.col("mid"), 4).alias("excess"))


@query("w12_15_regime", B.sql("""
, m AS (SELECT date, level, count(level) OVER f AS n, median(level) OVER f AS mid, level - lag(level, 21) OVER w AS change FROM benchmark WINDOW w AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
flags AS (SELECT *, CASE WHEN n >= 60 THEN level > mid END AS above, change > 0 AS rising FROM m),
votes AS (SELECT *, (CASE WHEN above THEN 1 ELSE 0 END) + (CASE WHEN rising THEN 1 ELSE 0 END) AS yes, (CASE WHEN above IS NULL THEN 0 ELSE 1 END) + (CASE WHEN rising IS NULL THEN 0 ELSE 1 END) AS known FROM flags),
risk AS (SELECT *, CASE WHEN known > 0 THEN yes * 2 > known END AS risk_on FROM votes)
SELECT date, above, rising, risk_on, coalesce(CASE WHEN lag(risk_on) OVER (ORDER BY date) THEN 1.0 WHEN NOT lag(risk_on) OVER (ORDER BY date) THEN 0.5 END, 1.0)::DOUBLE AS exposure FROM risk"""))
def w12_15_regime(spark, sf_dir):
    """Rolling median with 60 rows at least, 21-row difference, majority of known flags, overlay by the previous row.

    The market series has one row a trading day, so one window without partitions is small.
    """
    w = Window.orderBy("date")
    year = w.rowsBetween(-251, 0)
    m = B.benchmark(spark, sf_dir).select("date", "level", F.count("level").over(year).alias("n"), F.expr("percentile(level, 0.5)").over(year).alias("mid"), (F.col("level") - F.lag("level", 21).over(w)).alias("change"))
    flags = m.select("date", F.when(F.col("n") >= 60, F.col("level") > F.col("mid")).alias("above"), (F.col("change") > 0).alias("rising"))
    one = lambda c: F.when(F.col(c), 1).otherwise(0)
    known = F.col("above").isNotNull().cast("int") + F.col("rising").isNotNull().cast("int")
    risk = flags.withColumn("risk_on", F.when(known > 0, (one("above") + one("rising")) * 2 > known))
    before = F.lag("risk_on").over(w)
    return risk.withColumn("exposure", F.when(before, 1.0).when(~before, 0.5).otherwise(1.0))


@query("w16_18_equity_path", B.sql(_RET + """
, e AS (SELECT issuer, date, close, exp(sum(ln(1 + coalesce(ret, 0))) OVER u) AS equity, close / max(close) OVER u - 1 AS dd, greatest(max(close) OVER p, first_value(open) OVER w) AS peak FROM rets
  WINDOW w AS (PARTITION BY issuer ORDER BY date), u AS (PARTITION BY issuer ORDER BY date ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY issuer ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT issuer, date, round(equity, 4) AS equity, round(dd, 4) AS drawdown, round(peak, 4) AS peak_before FROM e"""))
def w16_18_equity_path(spark, sf_dir):
    """Cumulative product, drawdown, and the peak strictly before the row, floored by the entry."""
    w = Window.partitionBy("issuer").orderBy("date")
    up, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = X.with_returns(B.bars(spark, sf_dir))
    return rows.select("issuer", "date", F.round(F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(up)), 4).alias("equity"), F.round(F.col("close") / F.max("close").over(up) - 1, 4).alias("drawdown"), F.round(F.greatest(F.max("close").over(past), F.first("open").over(w)), 4).alias("peak_before"))


@query("w19_20_breach_and_last", B.sql("""
, f AS (SELECT *, first_value(close) OVER (PARTITION BY issuer ORDER BY date) AS entry FROM bars)
SELECT issuer, min(date) FILTER (low <= 0.5 * entry) AS first_breach, max(date) FILTER (close IS NOT NULL) AS last_valid FROM f GROUP BY issuer"""))
def w19_20_breach_and_last(spark, sf_dir):
    rows = B.bars(spark, sf_dir).withColumn("entry", F.first("close").over(Window.partitionBy("issuer").orderBy("date")))
    return rows.groupBy("issuer").agg(F.min(F.when(F.col("low") <= 0.5 * F.col("entry"), F.col("date"))).alias("first_breach"), F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_valid"))


@query("w23_prior_counts", B.sql("SELECT tx_id, count(*) OVER o AS prior_by_owner, count(*) OVER i AS prior_at_issuer FROM buys WINDOW o AS (PARTITION BY owner ORDER BY tx_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), i AS (PARTITION BY issuer ORDER BY tx_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"))
def w23_prior_counts(spark, sf_dir):
    """Earlier days only: rows of the same day don't count (same-day staging)."""
    day = F.unix_date("tx_date")
    past = lambda k: Window.partitionBy(k).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    return B.buys(spark, sf_dir).select("tx_id", F.count("*").over(past("owner")).alias("prior_by_owner"), F.count("*").over(past("issuer")).alias("prior_at_issuer"))


@query("w27_discontinuities", B.sql("""
, j AS (SELECT issuer, date, close / lag(close) OVER w AS ratio, list_sort(list(volume) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS b, list_sort(list(volume) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS a FROM bars WINDOW w AS (PARTITION BY issuer ORDER BY date))
SELECT issuer, date, round(ratio, 4) AS ratio, round(b[len(b) // 2 + 1], 4) AS volume_before, round(a[len(a) // 2 + 1], 4) AS volume_after FROM j WHERE ratio >= 3 OR ratio <= 1.0 / 3"""))
def w27_discontinuities(spark, sf_dir):
    return X.discontinuities(B.bars(spark, sf_dir)).select("issuer", "date", _r("ratio"), _r("volume_before"), _r("volume_after"))


_GAP = ", ".join(f"abs(ln(ratio) - ln({float(r) ** s!r}))" for r in X.SPLIT_RATIOS for s in (1, -1))


@query("e09_split_classes", B.sql(f"""
, j AS (SELECT issuer, date, close / lag(close) OVER w AS ratio, list_sort(list(volume) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS b, list_sort(list(volume) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS a FROM bars WINDOW w AS (PARTITION BY issuer ORDER BY date)),
k AS (SELECT *, a[len(a) // 2 + 1] / nullif(b[len(b) // 2 + 1], 0) AS vr, least({_GAP}) <= ln(1.10) AS near FROM j WHERE ratio >= 3 OR ratio <= 1.0 / 3),
g AS (SELECT *, CASE WHEN ratio > 1 THEN vr <= 0.8 ELSE vr >= 1.25 END AS against FROM k)
SELECT issuer, date, CASE WHEN near AND against THEN 'split' WHEN NOT near AND NOT coalesce(against, false) THEN 'real_move' ELSE 'ambiguous' END AS class FROM g"""))
def e09_split_classes(spark, sf_dir):
    return X.discontinuities(B.bars(spark, sf_dir)).select("issuer", "date", X.classify_split().alias("class"))


@query("e10_back_adjusted", B.sql("""
, s AS (SELECT issuer, date, close, volume, CASE WHEN close / lag(close) OVER (PARTITION BY issuer ORDER BY date) >= 10 THEN 10.0 ELSE 1.0 END AS factor FROM bars),
a AS (SELECT *, exp(coalesce(sum(ln(factor)) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS f FROM s)
SELECT issuer, date, round(ln(close * f), 6) AS ln_close, round(ln(volume / f), 6) AS ln_volume FROM a"""))
def e10_back_adjusted(spark, sf_dir):
    bars = B.bars(spark, sf_dir)
    jump = F.col("close") / F.lag("close").over(Window.partitionBy("issuer").orderBy("date"))
    splits = bars.select("issuer", "date", F.when(jump >= 10, 10.0).alias("factor")).filter("factor IS NOT NULL")
    return X.back_adjust(bars, splits).select("issuer", "date", F.round(F.log("close"), 6).alias("ln_close"), F.round(F.log("volume"), 6).alias("ln_volume"))


@query("e14_suspects", B.sql("""
, j AS (SELECT issuer, date, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) AS ratio FROM bars)
SELECT issuer, min(date) AS first_date, round(arg_min(ratio, date), 4) AS ratio FROM j WHERE ratio >= 3 OR ratio <= 1.0 / 3 GROUP BY issuer"""))
def e14_suspects(spark, sf_dir):
    return X.discontinuities(B.bars(spark, sf_dir)).groupBy("issuer").agg(F.min("date").alias("first_date"), F.round(F.min_by("ratio", "date"), 4).alias("ratio"))


@query("w28_ranked_picks", B.sql(_PERIOD_RANK + ", p AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, issuer, date) AS pick FROM periods) SELECT CAST(period AS BIGINT) AS period, CAST(pick AS INTEGER) AS pick, issuer, date FROM p WHERE pick <= 5"))
def w28_ranked_picks(spark, sf_dir):
    """Also S2: the five best of each period, ties by issuer and day."""
    rows = _scored(spark, sf_dir).withColumn("period", F.floor(F.col("idx") / 21))
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("score"), "issuer", "date"))).filter("pick <= 5").select("period", "pick", "issuer", "date")


@query("w29_rank_average", B.sql("""
, m AS (SELECT issuer, date, volume AS a, dollar_volume AS b, CASE WHEN high > low THEN high / low END AS c FROM bars),
r AS (SELECT issuer, date, """ + ", ".join(f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {v} NULLS LAST) + (count({v}) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY date) END AS r{v}" for v in "abc") + """ FROM m)
SELECT issuer, date, round((coalesce(ra, 0) + coalesce(rb, 0) + coalesce(rc, 0)) / ((ra IS NOT NULL)::INT + (rb IS NOT NULL)::INT + (rc IS NOT NULL)::INT), 6) AS average FROM r"""))
def w29_rank_average(spark, sf_dir):
    rows = B.bars(spark, sf_dir).select("issuer", "date", F.col("volume").alias("a"), F.col("dollar_volume").alias("b"), F.when(F.col("high") > F.col("low"), F.col("high") / F.col("low")).alias("c"))
    ranks = rows.select("issuer", "date", *[S.percent_rank_average(v, ["date"]).alias(v) for v in "abc"])
    known = sum((F.col(v).isNotNull().cast("int") for v in "abc"), F.lit(0))
    return ranks.select("issuer", "date", F.round(sum((F.coalesce(v, F.lit(0.0)) for v in "abc"), F.lit(0.0)) / known, 6).alias("average"))


@query("w30_expected_filing", B.sql("""
, f AS (SELECT DISTINCT o_custkey AS issuer, CAST(o_orderdate AS DATE) AS date FROM orders),
g AS (SELECT issuer, date, date - lag(date) OVER (PARTITION BY issuer ORDER BY date) AS gap FROM f),
m AS (SELECT issuer, date, median(gap) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mid FROM g)
SELECT issuer, date, round(coalesce(mid, 91), 4) AS gap, CAST(date + CAST(floor(coalesce(mid, 91)) AS INTEGER) AS DATE) AS expected FROM m"""))
def w30_expected_filing(spark, sf_dir):
    """Median of the gaps so far, 91 days before the second filing."""
    w = Window.partitionBy("issuer").orderBy("date")
    days = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.col("o_orderdate").cast("date").alias("date")).distinct()
    gaps = days.withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    mid = F.coalesce(F.expr("percentile(gap, 0.5)").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(91.0))
    return gaps.select("issuer", "date", F.round(mid, 4).alias("gap"), F.date_add("date", F.floor(mid).cast("int")).alias("expected"))


@query("w31_downsample", B.sql("""
, whole AS (SELECT CAST(l_shipdate AS DATE) AS date, round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE), 6) AS level FROM lineitem GROUP BY ALL),
n AS (SELECT date, level, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS total FROM whole),
b AS (SELECT *, i // CAST(ceil(total / 200.0) AS BIGINT) AS bucket FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY level, date) AS by_low, i % CAST(ceil(total / 200.0) AS BIGINT) = 0 AS on_stride FROM b)
SELECT date, level, on_stride OR i = total - 1 AS uniform, by_low = 1 OR i = total - 1 AS keeps_minimum FROM k WHERE on_stride OR i = total - 1 OR by_low = 1"""))
def w31_downsample(spark, sf_dir):
    """A stride of ceil(n / 200), the last point kept; beside it each bucket's minimum."""
    level = F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / F.sum(F.col("l_quantity").cast("bigint")).cast("double"), 6).alias("level")  # in whole cents: any order of rows gives this sum
    w = Window.orderBy("date")  # one row a trading day
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(level).select("date", "level", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("total"))
    step = F.ceil(F.col("total") / 200)
    rows = rows.withColumn("bucket", F.floor(F.col("i") / step)).withColumn("low", F.row_number().over(Window.partitionBy("bucket").orderBy("level", "date")) == 1)
    last = F.col("i") == F.col("total") - 1
    on = F.col("i") % step == 0
    return rows.filter(on | last | F.col("low")).select("date", "level", (on | last).alias("uniform"), (F.col("low") | last).alias("keeps_minimum"))
