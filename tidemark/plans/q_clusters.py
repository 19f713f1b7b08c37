"""Clusters, flags, state and episodes over the purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from . import binding as B
from .registry import query

_CLUSTERS = """
, win AS (
  SELECT a.issuer, a.tx_date AS s, max(b.tx_date) AS e, count(DISTINCT b.owner) AS n
  FROM (SELECT DISTINCT issuer, tx_date FROM buys) a JOIN buys b ON a.issuer = b.issuer AND b.tx_date BETWEEN a.tx_date AND a.tx_date + 14
  GROUP BY ALL HAVING n >= {k}),
nxt AS (SELECT w.issuer, w.s, w.e, min(x.s) AS ns FROM win w LEFT JOIN win x ON x.issuer = w.issuer AND x.s > w.e GROUP BY ALL),
chain AS (
  SELECT issuer, s, e, ns FROM nxt WHERE (issuer, s) IN (SELECT issuer, min(s) FROM nxt GROUP BY issuer)
  UNION ALL SELECT n.issuer, n.s, n.e, n.ns FROM chain c JOIN nxt n ON n.issuer = c.issuer AND n.s = c.ns),
clusters AS (SELECT issuer, s AS first_date, e AS last_date FROM chain)"""


def _clusters(k: int) -> str:
    return _CLUSTERS.format(k=k)


_ROWS = """
, cluster_rows AS (SELECT c.first_date, c.last_date, b.* FROM clusters c JOIN buys b ON b.issuer = c.issuer AND b.tx_date BETWEEN c.first_date AND c.last_date)"""


@query("e1_clusters", B.sql(_clusters(2) + " SELECT * FROM clusters"))
def e1_clusters(spark, sf_dir):
    return C.detect_clusters(B.buys(spark, sf_dir))


@query("e1_clusters_three", B.sql(_clusters(3) + " SELECT * FROM clusters"))
def e1_clusters_three(spark, sf_dir):
    return C.detect_clusters(B.buys(spark, sf_dir), buyers=3)


@query(
    "e2_cluster_record",
    B.sql(_clusters(2) + _ROWS + """
, owners AS (SELECT issuer, first_date, last_date, owner, sum(value) AS v, count(*) AS n FROM cluster_rows GROUP BY ALL)
SELECT issuer, first_date, last_date, count(*) AS num_insiders, CAST(sum(n) AS BIGINT) AS num_tx, round(sum(v), 4) AS total_value, round(max(v), 4) AS top_value FROM owners GROUP BY ALL"""),
)
def e2_cluster_record(spark, sf_dir):
    rows = B.buys(spark, sf_dir)
    owners = C.cluster_rows(C.detect_clusters(rows), rows).groupBy("issuer", "first_date", "last_date", "owner").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return owners.groupBy("issuer", "first_date", "last_date").agg(F.count("*").alias("num_insiders"), F.sum("n").alias("num_tx"), F.round(F.sum("v"), 4).alias("total_value"), F.round(F.max("v"), 4).alias("top_value"))


@query(
    "a9_cluster_aggregates",
    B.sql(_clusters(2) + _ROWS + """
SELECT issuer, first_date, count(DISTINCT owner) AS n_owners, bool_or(is_officer) AS has_officer, bool_or(NOT is_ten OR is_officer OR is_director) AS has_not_ten_only, round(sum(value), 4) AS total
FROM cluster_rows GROUP BY ALL"""),
)
def a9_cluster_aggregates(spark, sf_dir):
    rows = B.buys(spark, sf_dir)
    return C.cluster_rows(C.detect_clusters(rows), rows).groupBy("issuer", "first_date").agg(
        F.countDistinct("owner").alias("n_owners"), F.bool_or("is_officer").alias("has_officer"), F.bool_or(~F.col("is_ten") | F.col("is_officer") | F.col("is_director")).alias("has_not_ten_only"), F.round(F.sum("value"), 4).alias("total")
    )


#: The bound rows have whole shares and no notes: some get a quarter share, and each its order's status and priority as a note.
_NOTED = """
, first_bars AS (SELECT issuer, min(date) AS first_trade FROM bars GROUP BY issuer),
noted AS (
  SELECT c.* REPLACE (shares + CASE WHEN tx_id % 10 % 2 = 1 THEN 0.25 ELSE 0 END AS shares), CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'payroll  deduction' WHEN o_orderstatus = 'O' THEN 'open market' END AS note, first_trade
  FROM cluster_rows c JOIN orders ON o_orderkey = tx_id // 10 LEFT JOIN first_bars USING (issuer))"""

_FLAG_SQL = _NOTED + """
, owned AS (SELECT issuer, first_date, owner, bool_or(is_director) AS d, bool_or(is_officer) AS o, bool_or(is_ten) AS t, bool_or(is_director AND NOT is_officer) AS pure, sum(value) AS v FROM noted GROUP BY ALL),
per_owner AS (
  SELECT issuer, first_date, count(*) AS n_insiders, bool_or(o) AS any_officer, bool_or(d) AS any_director, bool_or(t) AS any_ten, count(*) FILTER (pure) AS pure, sum(v) AS total_value, list_sort(list(v) FILTER (v <> 0)) AS vs
  FROM owned GROUP BY ALL),
measures AS (
  SELECT issuer, first_date, count(*) AS n_tx, count(DISTINCT round_even(price, 4)) AS n_unique, count(price) AS n_prices, (max(price) - min(price)) / max(price) AS spread, count(DISTINCT tx_date) AS n_dates, max(tx_date) AS last_tx,
         count(*) FILTER (abs(shares - round_even(shares, 0)) > 1e-4) AS fractional, bool_or(is_plan) AS any_plan, bool_or(regexp_matches(coalesce(note, ''), '(?i)ESPP|payroll\\s+deduction|401\\s*\\(?\\s*k')) AS any_note,
         avg(pct) AS mean_pct, max(pct) AS max_pct, list_sort(list(filing_date - tx_date)) AS ds, min(first_trade) AS first_trade
  FROM noted GROUP BY ALL),
both_ AS (SELECT *, vs[len(vs) // 2 + 1] AS median_value, ds[len(ds) // 2 + 1] AS median_delay FROM measures JOIN per_owner USING (issuer, first_date)),
flags AS (
  SELECT issuer, first_date, n_tx, n_insiders, median_value, median_delay, total_value,
         median_value >= 100000 AS f_median_value_high, median_value <= 5000 AS f_median_value_low, n_prices >= 3 AND n_unique = 1 AS f_identical_prices, n_prices >= 3 AND n_unique > 1 AND spread < 0.005 AS f_tight_price_band,
         n_dates >= 3 AS f_multi_date_spread, n_dates = 1 AND n_tx >= 4 AS f_single_day_burst, fractional >= greatest(2, n_tx // 2) AS f_fractional_shares, any_ten AS f_ten_percent_owner,
         any_director AND NOT any_officer AS f_directors_only, any_note AS f_routine_footnote, any_plan AS f_plan_10b5_1, last_tx - first_trade BETWEEN 0 AND 179 AS f_recent_ipo, mean_pct >= 25 AS f_big_stake_add,
         median_delay <= 2 AS f_filed_promptly, median_delay >= 10 AS f_filed_late, n_insiders >= 2 AND pure * 2 > n_insiders AS f_director_heavy, n_insiders >= 3 AS f_three_plus_insiders, n_insiders >= 5 AS f_five_plus_insiders,
         total_value >= 1000000 AS f_large_total_value, any_officer AND any_director AS f_officer_and_director, max_pct >= 100 AS f_huge_stake_add, any_ten AND n_insiders >= 3 AS f_ten_pct_owner_multi
  FROM both_)"""


def noted_rows(spark, sf_dir, rows):
    """Rows with a quarter share on some, a note and the issuer's first trading day."""
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_order"), "o_orderpriority", "o_orderstatus")
    first = B.bars(spark, sf_dir).groupBy("issuer").agg(F.min("date").alias("first_trade"))
    note = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "payroll  deduction").when(F.col("o_orderstatus") == "O", "open market")
    quarter = F.when(F.col("tx_id") % 10 % 2 == 1, 0.25).otherwise(0.0)
    joined = rows.withColumn("shares", F.col("shares") + quarter).join(orders, F.floor(F.col("tx_id") / 10) == F.col("_order")).join(first, "issuer", "left")
    return joined.withColumn("note", note).drop("_order", "o_orderpriority", "o_orderstatus")


def _flags(spark, sf_dir):
    rows = B.buys(spark, sf_dir)
    return C.component_flags(noted_rows(spark, sf_dir, C.cluster_rows(C.detect_clusters(rows), rows)), ["issuer", "first_date"])


_FLAG_COLUMNS = [f"f_{k}" for k in C.WEIGHTS]


@query("e3_component_flags", B.sql(_clusters(2) + _ROWS + _FLAG_SQL + f" SELECT issuer, first_date, n_tx, n_insiders, CAST(median_delay AS INTEGER) AS median_delay, round(median_value, 2) AS median_value, {', '.join(_FLAG_COLUMNS)} FROM flags"))
def e3_component_flags(spark, sf_dir):
    """All 22 flags of a cluster."""
    return _flags(spark, sf_dir).select("issuer", "first_date", "n_tx", "n_insiders", "median_delay", F.round("median_value", 2).alias("median_value"), *_FLAG_COLUMNS)


#: Fixed values, as in ``operators/clusters.py``, written out for the oracle.
_POINTS = {
    "median_value_high": 3, "median_value_low": -2, "identical_prices": -3, "tight_price_band": -2, "multi_date_spread": 1, "single_day_burst": -2, "fractional_shares": -2, "ten_percent_owner": 3, "directors_only": 2,
    "routine_footnote": -5, "plan_10b5_1": -1, "recent_ipo": -3, "big_stake_add": 2, "filed_promptly": 1, "filed_late": -1, "director_heavy": 2,
}
_SCORE_SQL = " + ".join(f"CASE WHEN f_{k} THEN {v} ELSE 0 END" for k, v in _POINTS.items())


@query("e4_weighted_score", B.sql(_clusters(2) + _ROWS + _FLAG_SQL + f" SELECT issuer, first_date, CAST({_SCORE_SQL} AS INTEGER) AS score, CASE WHEN {_SCORE_SQL} >= 3 THEN 'conviction' WHEN {_SCORE_SQL} <= -3 THEN 'routine' ELSE 'mixed' END AS label FROM flags"))
def e4_weighted_score(spark, sf_dir):
    """Also P16, the label at +-3."""
    scored = _flags(spark, sf_dir).select("issuer", "first_date", C.weighted_score().alias("score"))
    return scored.withColumn("label", C.score_label(F.col("score")))


@query("e4_merged_weights", B.sql(_clusters(2) + _ROWS + _FLAG_SQL + f" SELECT issuer, first_date, CAST({_SCORE_SQL} + CASE WHEN f_large_total_value THEN 4 ELSE 0 END - CASE WHEN f_filed_late THEN 6 ELSE 0 END AS INTEGER) AS score FROM flags"))
def e4_merged_weights(spark, sf_dir):
    """SRC19: a payload's weights over the defaults; unknown names and non-integers are ignored."""
    payload = {"version": 1, "weights": {"large_total_value": 4, "filed_late": "-7", "no_such_flag": 9, "filed_promptly": "many"}}
    return _flags(spark, sf_dir).select("issuer", "first_date", C.weighted_score(payload).alias("score"))


_STATE = """
, shown AS (SELECT b.*, CAST(unnest(generate_series(filing_date, tx_date + 13, INTERVAL 1 DAY)) AS DATE) AS day FROM buys b WHERE filing_date <= tx_date + 13),
owner_day AS (SELECT issuer, day, owner, sum(value) AS v, bool_or(is_director) AS d, bool_or(is_officer) AS o, bool_or(is_ten) AS t, max(pct) AS p, bool_or(is_plan) AS plan, count(*) AS n FROM shown GROUP BY ALL),
state AS (
  SELECT issuer, day, count(*) AS num_insiders, CAST(sum(n) AS BIGINT) AS num_tx, sum(v) AS total_value, count(*) FILTER (d) AS directors, count(*) FILTER (o) AS officers,
         count(*) FILTER (t) AS ten_pct, max(p) AS max_pct, bool_or(plan) AS any_plan FROM owner_day GROUP BY ALL)"""


@query("e5_daily_state", B.sql(_STATE + " SELECT * REPLACE (round(total_value, 4) AS total_value, round(max_pct, 4) AS max_pct) FROM state"))
def e5_daily_state(spark, sf_dir):
    """Also J10 (band join by exploded days), A1 and A2."""
    return C.daily_state(B.buys(spark, sf_dir)).withColumn("total_value", F.round("total_value", 4)).withColumn("max_pct", F.round("max_pct", 4))


_EPISODES = _STATE + """
, on_days AS (SELECT issuer, date, idx, lag(idx) OVER (PARTITION BY issuer ORDER BY idx) AS before FROM state JOIN calendar ON day = date WHERE num_insiders >= 2),
episodes AS (SELECT issuer, date AS event_day, idx FROM on_days WHERE before IS NULL OR before < idx - 1)"""


@query("w21_episodes", B.sql(_EPISODES + " SELECT * FROM episodes"))
def w21_episodes(spark, sf_dir):
    """Also U4, the set difference between days."""
    return C.episodes(C.daily_state(B.buys(spark, sf_dir)), B.calendar(spark, sf_dir), F.col("num_insiders") >= 2)


def episode_rows(spark, sf_dir):
    return w21_episodes(spark, sf_dir)


EPISODES_SQL = _EPISODES


@query("w22_days_since_previous", B.sql(_EPISODES + """
SELECT issuer, event_day, CAST(event_day - lag(event_day) OVER w AS INTEGER) AS days_since, row_number() OVER w = 1 AS first_ever FROM episodes WINDOW w AS (PARTITION BY issuer ORDER BY event_day)"""))
def w22_days_since_previous(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("issuer").orderBy("event_day")
    return episode_rows(spark, sf_dir).select("issuer", "event_day", F.datediff("event_day", F.lag("event_day").over(w)).alias("days_since"), (F.row_number().over(w) == 1).alias("first_ever"))
