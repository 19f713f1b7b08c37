"""Forward labels, episode features, folds and validation statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import windows as X
from ..operators.asof import asof_backward, positional
from ..operators.rangejoin import range_join
from . import binding as B
from .q_clusters import EPISODES_SQL, episode_rows
from .registry import query

_ENTRY = EPISODES_SQL + """
, entry AS (SELECT e.issuer, e.event_day, p.date AS entry_day, p.open AS entry_open, c.idx AS entry_idx FROM episodes e JOIN bars p ON p.issuer = e.issuer AND p.date = (SELECT min(q.date) FROM bars q WHERE q.issuer = e.issuer AND q.date > e.event_day AND q.date <= e.event_day + 5) JOIN calendar c ON c.date = p.date),
exit_day AS (SELECT n.*, c.date AS exit_date FROM entry n JOIN calendar c ON c.idx = n.entry_idx + {h}),
fwd AS (SELECT x.*, o.open AS exit_open, a.close AS last_close FROM exit_day x LEFT JOIN bars o ON o.issuer = x.issuer AND o.date = x.exit_date ASOF LEFT JOIN bars a ON a.issuer = x.issuer AND x.exit_date >= a.date)"""


def entries(spark, sf_dir):
    """Episodes with the first bar after the event day, within five days."""
    found = asof_backward(episode_rows(spark, sf_dir).select("issuer", "event_day"), B.bars(spark, sf_dir), by=["issuer"], probe_on="event_day", fact_on="date", values=["open"], strict=True, forward=True, tolerance=5)
    days = B.calendar(spark, sf_dir).select(F.col("date").alias("entry_day"), F.col("idx").alias("entry_idx"))
    return found.select("issuer", "event_day", F.col("asof_date").alias("entry_day"), F.col("open").alias("entry_open")).filter("entry_day IS NOT NULL").join(F.broadcast(days), "entry_day")


def forward(spark, sf_dir, h: int):
    """Open-to-open return over ``h`` trading days; the last close where there is no open (delisted)."""
    bars = B.bars(spark, sf_dir)
    rows = positional(entries(spark, sf_dir), B.calendar(spark, sf_dir), idx="entry_idx", offset=h, name="exit_date").filter("exit_date IS NOT NULL")
    opens = bars.select("issuer", F.col("date").alias("exit_date"), F.col("open").alias("exit_open"))
    rows = rows.join(opens, ["issuer", "exit_date"], "left")
    return asof_backward(rows, bars.select("issuer", "date", F.col("close").alias("last_close")), by=["issuer"], probe_on="exit_date", fact_on="date", values=["last_close"]).drop("asof_date")


@query("d03_forward_label", B.sql(_ENTRY.format(h=63) + """
SELECT issuer, event_day, entry_day, round(coalesce(exit_open, last_close) / entry_open - 1, 6) AS fwd, exit_open IS NULL AS delisted, round(coalesce(exit_open, last_close) / entry_open - b2.level / b1.level, 6) AS adj
FROM fwd JOIN benchmark b1 ON b1.date = entry_day JOIN benchmark b2 ON b2.date = exit_date"""))
def d03_forward_label(spark, sf_dir):
    level = B.benchmark(spark, sf_dir)
    at = lambda c, n: F.broadcast(level.select(F.col("date").alias(c), F.col("level").alias(n)))
    rows = forward(spark, sf_dir, 63).join(at("entry_day", "b1"), "entry_day").join(at("exit_date", "b2"), "exit_date")
    price = F.coalesce("exit_open", "last_close")
    return rows.select("issuer", "event_day", "entry_day", F.round(price / F.col("entry_open") - 1, 6).alias("fwd"), F.col("exit_open").isNull().alias("delisted"), F.round(price / F.col("entry_open") - F.col("b2") / F.col("b1"), 6).alias("adj"))


@query("d01_episode_dataset", B.sql("".join([_ENTRY.format(h=10)]) + """
SELECT issuer, event_day, entry_day, round(entry_open, 6) AS entry_open, round(coalesce(exit_open, last_close) / entry_open - 1, 6) AS fwd_10, num_insiders, round(total_value, 4) AS total_value
FROM fwd JOIN state ON state.issuer = fwd.issuer AND state.day = fwd.event_day""").replace("SELECT issuer, event_day, entry_day, round(entry_open", "SELECT fwd.issuer, event_day, entry_day, round(entry_open"))
def d01_episode_dataset(spark, sf_dir):
    from ..operators.clusters import daily_state

    state = daily_state(B.buys(spark, sf_dir)).select("issuer", F.col("day").alias("event_day"), "num_insiders", "total_value")
    rows = forward(spark, sf_dir, 10).join(state, ["issuer", "event_day"])
    return rows.select("issuer", "event_day", "entry_day", F.round("entry_open", 6).alias("entry_open"), F.round(F.coalesce("exit_open", "last_close") / F.col("entry_open") - 1, 6).alias("fwd_10"), "num_insiders", F.round("total_value", 4).alias("total_value"))


_VISIBLE = EPISODES_SQL + ", v AS (SELECT e.issuer AS iss, e.event_day, b.* FROM episodes e JOIN buys b ON b.issuer = e.issuer AND b.tx_date BETWEEN e.event_day - 13 AND e.event_day AND b.filing_date <= e.event_day)"


def _visible(spark, sf_dir):
    rows = B.buys(spark, sf_dir)
    return range_join(episode_rows(spark, sf_dir), rows, by=["issuer"], probe_on="event_day", fact_on="tx_date", before=13, condition=F.col("filing_date") <= F.col("event_day"))


@query("d04_d06_shape_roles_stake", B.sql(_VISIBLE + """
SELECT iss AS issuer, event_day, count(*) AS n_tx, count(DISTINCT owner) AS n_owners, round(sum(value), 4) AS total, round(median(value), 4) AS median_value, round(sum(shares * price) / nullif(sum(shares), 0), 6) AS vwap,
       round(sum(value) FILTER (is_officer) / nullif(sum(value), 0), 6) AS officer_share, round(sum(value) FILTER (is_director) / nullif(sum(value), 0), 6) AS director_share,
       round(max(pct), 4) AS max_pct, round(median(pct), 4) AS median_pct, round(sum(pct * value) / nullif(sum(value), 0), 4) AS weighted_pct FROM v GROUP BY ALL"""))
def d04_d06_shape_roles_stake(spark, sf_dir):
    """Sections A to C of the features, with A5 (true median), A6 (weighted mean) and A7 (VWAP)."""
    share = lambda c: F.round(F.try_divide(F.sum(F.when(F.col(c), F.col("value"))), F.sum("value")), 6)
    return _visible(spark, sf_dir).groupBy("issuer", "event_day").agg(
        F.count("*").alias("n_tx"), F.countDistinct("owner").alias("n_owners"), F.round(F.sum("value"), 4).alias("total"), F.round(F.median("value"), 4).alias("median_value"),
        F.round(F.try_divide(F.sum(F.col("shares") * F.col("price")), F.sum("shares")), 6).alias("vwap"), share("is_officer").alias("officer_share"), share("is_director").alias("director_share"),
        F.round(F.max("pct"), 4).alias("max_pct"), F.round(F.median("pct"), 4).alias("median_pct"), F.round(F.try_divide(F.sum(F.col("pct") * F.col("value")), F.sum("value")), 4).alias("weighted_pct"),
    )


@query("d16_targets", B.sql(_ENTRY.format(h=63) + """
, y AS (SELECT issuer, event_day, date_trunc('month', event_day) AS m, least(coalesce(exit_open, last_close) / entry_open - 1, 5.0) AS r FROM fwd)
SELECT issuer, event_day, round(r - median(r) OVER (PARTITION BY m), 6) AS month_relative, r <= -0.3 AS crash, r >= 0.5 AS upside, CAST(least(floor((rank() OVER (PARTITION BY m ORDER BY r) - 1) * 5.0 / count(*) OVER (PARTITION BY m)), 4) AS BIGINT) AS grade FROM y"""))
def d16_targets(spark, sf_dir):
    rows = forward(spark, sf_dir, 63).select("issuer", "event_day", F.trunc("event_day", "month").alias("m"), F.least(F.coalesce("exit_open", "last_close") / F.col("entry_open") - 1, F.lit(5.0)).alias("r"))
    month = Window.partitionBy("m")
    grade = F.least(F.floor((F.rank().over(month.orderBy("r")) - 1) * 5 / F.count("*").over(month)), F.lit(4).cast("bigint"))
    return rows.select("issuer", "event_day", F.round(F.col("r") - F.median("r").over(month), 6).alias("month_relative"), (F.col("r") <= -0.3).alias("crash"), (F.col("r") >= 0.5).alias("upside"), grade.alias("grade"))


_SIGNAL = """
, rets AS (SELECT *, lead(close, 21) OVER (PARTITION BY issuer ORDER BY date) / close - 1 AS y, lag(close, 5) OVER (PARTITION BY issuer ORDER BY date) / close - 1 AS x FROM bars),
sig AS (SELECT issuer, date, date_trunc('month', date)::DATE AS m, x, y FROM rets WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY x) + (count(*) OVER (PARTITION BY m, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY m ORDER BY y) + (count(*) OVER (PARTITION BY m, y) - 1) / 2.0 AS ry FROM sig),
ic AS (SELECT m, count(*) AS n, corr(rx, ry) AS ic FROM rk GROUP BY m HAVING count(*) >= 8)"""


def _signal(spark, sf_dir):
    w = Window.partitionBy("issuer").orderBy("date")
    rows = B.bars(spark, sf_dir).select("issuer", "date", F.trunc("date", "month").alias("m"), (F.lag("close", 5).over(w) / F.col("close") - 1).alias("x"), (F.lead("close", 21).over(w) / F.col("close") - 1).alias("y"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL")


def _monthly_ic(spark, sf_dir):
    rows = _signal(spark, sf_dir)
    ranked = rows.select("m", S.percent_rank_average("x", ["m"]).alias("rx"), S.percent_rank_average("y", ["m"]).alias("ry"))
    return ranked.groupBy("m").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic")).filter("n >= 8")


@query("v02_monthly_ic", B.sql(_SIGNAL + " SELECT m, n, round(ic, 6) AS ic FROM ic"))
def v02_monthly_ic(spark, sf_dir):
    """Spearman rank correlation inside each month (also V1)."""
    return _monthly_ic(spark, sf_dir).select("m", "n", F.round("ic", 6).alias("ic"))


@query("v04_ic_t_test", B.sql(_SIGNAL + " SELECT count(*) AS months, round(avg(ic), 6) AS mean_ic, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 4) AS t FROM ic"))
def v04_ic_t_test(spark, sf_dir):
    """Also A28."""
    return _monthly_ic(spark, sf_dir).agg(F.count("*").alias("months"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(S.t_stat("ic"), 4).alias("t"))


@query("a12_decile_table", B.sql(_SIGNAL + f", edges AS (SELECT m, [{', '.join(f'quantile_cont(x, {k / 10!r})' for k in range(11))}] AS es FROM sig GROUP BY m), d AS (SELECT y, greatest(len(list_filter(list_distinct(es), lambda e: e < x)) - 1, 0) AS decile FROM sig JOIN edges USING (m)) SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, round(avg(least(y, 10)), 6) AS mean, round(median(y), 6) AS mid, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(CASE WHEN y <= -0.3 THEN 1.0 ELSE 0.0 END), 6) AS crash FROM d GROUP BY ALL"))
def a12_decile_table(spark, sf_dir):
    """Deciles inside months, then returns, win rate and crash rate (also A13, V3's buckets)."""
    rows = S.qcut(_signal(spark, sf_dir), "x", 10, ["m"], "decile")
    return rows.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg(F.least("y", F.lit(10.0))), 6).alias("mean"), F.round(F.median("y"), 6).alias("mid"), F.round(F.avg((F.col("y") > 0).cast("double")), 6).alias("win"), F.round(F.avg((F.col("y") <= -0.3).cast("double")), 6).alias("crash"))


@query("m01_winsor", B.sql(_SIGNAL + ", q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM sig WHERE date < DATE '1999-01-01') SELECT issuer, date, round(greatest(lo, least(hi, x)), 6) AS x FROM sig, q WHERE date >= DATE '1999-01-01'"))
def m01_winsor(spark, sf_dir):
    """Bounds from the training part only."""
    rows = _signal(spark, sf_dir)
    bounds = rows.filter("date < '1999-01-01'").agg(F.percentile("x", F.lit(0.01)).alias("lo"), F.percentile("x", F.lit(0.99)).alias("hi"))
    return rows.filter("date >= '1999-01-01'").crossJoin(F.broadcast(bounds)).select("issuer", "date", F.round(F.greatest("lo", F.least("hi", "x")), 6).alias("x"))  # one row of bounds


@query("m06_purged_folds", B.sql(EPISODES_SQL + """
, d AS (SELECT issuer, event_day, idx, ntile(6) OVER (ORDER BY event_day, issuer) - 1 AS block FROM episodes),
b AS (SELECT block, min(event_day) AS first_day FROM d GROUP BY block)
SELECT CAST(b.block AS INTEGER) AS fold, count(*) FILTER (d.block = b.block) AS test, count(*) FILTER (d.block < b.block AND d.event_day + 91 + 5 < b.first_day) AS train FROM b JOIN d ON d.block <= b.block WHERE b.block > 0 GROUP BY ALL"""))
def m06_purged_folds(spark, sf_dir):
    """Expanding folds of n + 1 equal blocks; training rows whose label reaches into the test block, or its embargo, go."""
    rows = episode_rows(spark, sf_dir).withColumn("block", F.ntile(6).over(Window.orderBy("event_day", "issuer")) - 1)
    starts = rows.groupBy(F.col("block").alias("fold")).agg(F.min("event_day").alias("first_day")).filter("fold > 0")
    pairs = rows.join(F.broadcast(starts), F.col("block") <= F.col("fold"))  # five folds
    train = (F.col("block") < F.col("fold")) & (F.date_add("event_day", 96) < F.col("first_day"))
    return pairs.groupBy("fold").agg(F.count_if(F.col("block") == F.col("fold")).alias("test"), F.count_if(train).alias("train"))


@query("m05_flag_lift", B.sql(_VISIBLE + ", f AS (SELECT iss, event_day, bool_or(is_officer) AS officer, bool_or(is_plan) AS plan, count(DISTINCT owner) >= 3 AS hit FROM v GROUP BY ALL), u AS (SELECT 'officer' AS flag, officer AS on_, hit FROM f UNION ALL SELECT 'plan', plan, hit FROM f) SELECT flag, count(*) FILTER (on_) AS support, round(log2(greatest((count(*) FILTER (on_ AND hit)) / CAST(nullif(count(*) FILTER (on_), 0) AS DOUBLE), 0.001) / greatest(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 0.001)), 6) AS lift FROM u GROUP BY flag"))
def m05_flag_lift(spark, sf_dir):
    """log2 of the hit rate under the flag over the base rate, floored at 0.001."""
    facts = _visible(spark, sf_dir).groupBy("issuer", "event_day").agg(F.bool_or("is_officer").alias("officer"), F.bool_or("is_plan").alias("plan"), (F.countDistinct("owner") >= 3).alias("hit"))
    flags = facts.unpivot(["hit"], ["officer", "plan"], "flag", "on")
    under = F.try_divide(F.count_if(F.col("on") & F.col("hit")), F.count_if("on"))
    return flags.groupBy("flag").agg(F.count_if("on").alias("support"), F.round(F.log2(F.greatest(under, F.lit(0.001)) / F.greatest(F.avg(F.col("hit").cast("double")), F.lit(0.001))), 6).alias("lift"))


@query("v08_leak_guard", B.sql(_SIGNAL + ", rg AS (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM sig) SELECT round(corr(rx, ry), 6) AS rho, abs(corr(rx, ry)) > 0.5 AS leaks FROM rg"))
def v08_leak_guard(spark, sf_dir):
    """Rank correlation of a feature with its label; ranks come from counts of distinct values, not one global window."""
    rows = _signal(spark, sf_dir)

    def ranks(c):
        """Rank of each distinct value: one more than the rows below it."""
        return S.counts_before(rows.groupBy(c).agg(F.count("*").alias("k")), c, "k").select(c, (F.col("before") + 1).alias(f"r{c}"))

    both = rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.corr("rx", "ry").alias("c"))
    return both.select(F.round("c", 6).alias("rho"), (F.abs("c") > 0.5).alias("leaks"))


@query("d08_price_context", B.sql(_ENTRY.format(h=10) + """
, rr AS (SELECT *, close / lag(close) OVER (PARTITION BY issuer ORDER BY date) - 1 AS ret FROM bars),
fx AS (SELECT issuer, date, stddev_samp(ret) OVER (PARTITION BY issuer ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) * sqrt(252) AS vol, lag(close) OVER (PARTITION BY issuer ORDER BY date) / lag(close, 21) OVER (PARTITION BY issuer ORDER BY date) - 1 AS mom FROM rr)
SELECT n.issuer, n.event_day, round(vol, 4) AS vol_30, round(mom, 4) AS momentum_20 FROM entry n JOIN fx ON fx.issuer = n.issuer AND fx.date = n.entry_day"""))
def d08_price_context(spark, sf_dir):
    """Section E: features of bars strictly before the entry day."""
    w = Window.partitionBy("issuer").orderBy("date")
    bars = X.with_returns(B.bars(spark, sf_dir)).select("issuer", F.col("date").alias("entry_day"), (F.stddev_samp("ret").over(S.trailing("issuer", "date", 30)) * F.sqrt(F.lit(252))).alias("v"), (F.lag("close", 1).over(w) / F.lag("close", 21).over(w) - 1).alias("m"))
    return entries(spark, sf_dir).join(bars, ["issuer", "entry_day"]).select("issuer", "event_day", F.round("v", 4).alias("vol_30"), F.round("m", 4).alias("momentum_20"))
