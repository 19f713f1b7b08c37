"""Cluster detection, component flags and daily point-in-time state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import ROUTINE_NOTE
from .rangejoin import explode_days

WINDOW_DAYS = 14
STATE_DAYS = 14


def detect_clusters(rows: DataFrame, *, buyers: int = 2, days: int = WINDOW_DAYS) -> DataFrame:
    """(issuer, first_date, last_date): greedy maximal windows with enough distinct owners.

    From the earliest day not yet used the window runs ``days`` further; if it has at least
    ``buyers`` distinct owners it is emitted and the search goes on behind its last row, else from
    the next day. Rows without a date don't count; rows without an owner begin and extend windows but
    count as nobody. An owner's purchase on a day is counted by the windows that begin after the owner's
    purchase before it, so owners are counted by a running sum and never listed. The fold runs over an
    issuer's qualifying days, at most one a calendar day, never over its transactions.
    """
    by_owner = rows.filter("tx_date IS NOT NULL").select("issuer", "owner", F.unix_date("tx_date").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy("issuer", "owner").orderBy("day"))
    spans = by_owner.withColumn("low", F.greatest(F.col("day") - days, F.coalesce(before + 1, F.col("day") - days)))
    counts = F.when(F.col("owner").isNull(), 0).otherwise(1)
    steps = spans.select("issuer", F.explode(F.array(
        F.struct(F.col("low").alias("day"), counts.alias("more"), F.lit(False).alias("start")), F.struct(F.col("day"), F.lit(0).alias("more"), F.lit(True).alias("start")),
        F.struct((F.col("day") + 1).alias("day"), (-counts).alias("more"), F.lit(False).alias("start")),
    )).alias("s")).groupBy("issuer", "s.day").agg(F.sum("s.more").alias("more"), F.max("s.start").alias("start"))
    by_day = Window.partitionBy("issuer").orderBy("day")
    ahead = F.max(F.when(F.col("start"), F.col("day"))).over(by_day.rangeBetween(0, days))
    found = steps.select("issuer", "start", F.col("day").alias("s"), ahead.alias("e"), F.sum("more").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    ordered = found.filter(F.col("start") & (F.col("n") >= buyers)).groupBy("issuer").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("days"))
    empty = F.struct(F.lit(None).cast("int").alias("until"), F.array().cast("array<struct<s:int,e:int>>").alias("kept"))

    def step(state: Column, day: Column) -> Column:
        take = state["until"].isNull() | (day["s"] > state["until"])
        return F.struct(F.when(take, day["e"]).otherwise(state["until"]).alias("until"), F.when(take, F.concat(state["kept"], F.array(day))).otherwise(state["kept"]).alias("kept"))

    kept = ordered.select("issuer", F.explode(F.aggregate("days", empty, step, lambda s: s["kept"])).alias("c"))
    return kept.select("issuer", F.date_from_unix_date("c.s").alias("first_date"), F.date_from_unix_date("c.e").alias("last_date"))


def cluster_rows(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """Transactions of each cluster: an equi join on the day, as clusters of an issuer don't overlap."""
    days = clusters.withColumn("tx_date", F.explode(F.sequence("first_date", "last_date")))
    return rows.join(days, ["issuer", "tx_date"])


#: Points of each component flag.
WEIGHTS = {
    "median_value_high": 3,
    "median_value_low": -2,
    "identical_prices": -3,
    "tight_price_band": -2,
    "multi_date_spread": 1,
    "single_day_burst": -2,
    "fractional_shares": -2,
    "ten_percent_owner": 3,
    "directors_only": 2,
    "routine_footnote": -5,
    "plan_10b5_1": -1,
    "recent_ipo": -3,
    "big_stake_add": 2,
    "filed_promptly": 1,
    "filed_late": -1,
    "director_heavy": 2,
    "three_plus_insiders": 0,
    "five_plus_insiders": 0,
    "large_total_value": 0,
    "officer_and_director": 0,
    "huge_stake_add": 0,
    "ten_pct_owner_multi": 0,
}

#: Fixed value: days since the first trade within which a listing is recent.
RECENT_DAYS = 180


def component_flags(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key with the measures and a boolean f_<name> for each component flag.

    Rows have owner, value, shares, price, pct, dates, role and plan flags, note and first_trade (the issuer's, or
    null). Owners without an id are told apart by owner_name.
    """
    who = F.coalesce(F.col("owner").cast("string"), F.col("owner_name"))
    owner = rows.groupBy(*key, who.alias("who")).agg(
        F.max("is_director").alias("d"), F.max("is_officer").alias("o"), F.max("is_ten").alias("t"), F.bool_or(F.col("is_director") & ~F.col("is_officer")).alias("pure"), F.sum(F.coalesce("value", F.lit(0.0))).alias("v"),
    )
    ranked = owner.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy((F.col("v") == 0), "v"))).withColumn("some", F.count(F.when(F.col("v") != 0, 1)).over(Window.partitionBy(*key)))
    per_owner = ranked.groupBy(*key).agg(
        F.count("*").alias("n_insiders"), F.max("o").alias("any_officer"), F.max("d").alias("any_director"), F.max("t").alias("any_ten"), F.count_if("pure").alias("pure_directors"),
        F.sum("v").alias("total_value"), F.max(F.when((F.col("some") > 0) & (F.col("k") == F.floor(F.col("some") / 2) + 1), F.col("v"))).alias("median_value"),
    )
    priced = F.when(F.col("price") != 0, F.col("price"))
    measures = rows.groupBy(*key).agg(
        F.count("*").alias("n_tx"), F.min(F.bround(priced, 4)).alias("low4"), F.max(F.bround(priced, 4)).alias("high4"), F.count(priced).alias("n_prices"), F.try_divide(F.max(priced) - F.min(priced), F.max(priced)).alias("spread"),
        F.min("tx_date").alias("first_tx"), F.max("tx_date").alias("last_tx"), F.count_distinct("tx_date").alias("n_dates"),
        F.count_if(F.abs(F.col("shares") - F.bround("shares", 0)) > 1e-4).alias("fractional"), F.max("is_plan").alias("any_plan"), F.max(F.regexp_like("note", F.lit(ROUTINE_NOTE))).alias("any_note"),
        F.avg("pct").alias("mean_pct"), F.max("pct").alias("max_pct"), F.min("first_trade").alias("first_trade"),
    )
    delay = F.datediff("filing_date", "tx_date")
    delays = rows.filter(delay.isNotNull()).groupBy(*key, delay.alias("delay")).agg(F.count("*").alias("n"))  # few distinct values: a running count instead of a list
    upto = Window.partitionBy(*key).orderBy("delay").rowsBetween(Window.unboundedPreceding, 0)
    delays = delays.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
    middle = delays.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*key).agg(F.min("delay").alias("median_delay"))
    both = measures.join(per_owner, key).join(middle, key, "left")
    several = F.col("n_prices") >= 3
    flags = {
        "median_value_high": F.col("median_value") >= 100_000,
        "median_value_low": F.col("median_value") <= 5_000,
        "identical_prices": several & (F.col("low4") == F.col("high4")),
        "tight_price_band": several & (F.col("low4") != F.col("high4")) & (F.col("spread") < 0.005),
        "multi_date_spread": F.col("n_dates") >= 3,
        "single_day_burst": (F.col("n_dates") == 1) & (F.col("n_tx") >= 4),
        "fractional_shares": F.col("fractional") >= F.greatest(F.lit(2), F.floor(F.col("n_tx") / 2)),
        "ten_percent_owner": F.col("any_ten"),
        "directors_only": F.col("any_director") & ~F.col("any_officer"),
        "routine_footnote": F.col("any_note"),
        "plan_10b5_1": F.col("any_plan"),
        "recent_ipo": F.datediff("last_tx", "first_trade").between(0, RECENT_DAYS - 1),
        "big_stake_add": F.col("mean_pct") >= 25,
        "filed_promptly": F.col("median_delay") <= 2,
        "filed_late": F.col("median_delay") >= 10,
        "director_heavy": (F.col("n_insiders") >= 2) & (F.col("pure_directors") * 2 > F.col("n_insiders")),
        "three_plus_insiders": F.col("n_insiders") >= 3,
        "five_plus_insiders": F.col("n_insiders") >= 5,
        "large_total_value": F.col("total_value") >= 1_000_000,
        "officer_and_director": F.col("any_officer") & F.col("any_director"),
        "huge_stake_add": F.col("max_pct") >= 100,
        "ten_pct_owner_multi": F.col("any_ten") & (F.col("n_insiders") >= 3),
    }
    return both.select("*", *[F.coalesce(f, F.lit(False)).alias(f"f_{k}") for k, f in flags.items()])


def merged_weights(payload: dict | None) -> dict[str, int]:
    """Points of a weights file, {"weights": {...}} or flat, over the defaults: unknown names and what is no integer are ignored."""
    given = payload.get("weights", payload) if isinstance(payload, dict) else None
    merged = dict(WEIGHTS)
    for name, value in (given if isinstance(given, dict) else {}).items():
        if name in merged:
            try:
                merged[name] = int(value)
            except (TypeError, ValueError):
                continue
    return merged


def weighted_score(weights: dict[str, int] | None = None) -> Column:
    """Sum of the points of fired flags; names that aren't given keep their default points."""
    total = F.lit(0)
    for name, points in merged_weights(weights).items():
        if points:
            total = total + F.when(F.col(f"f_{name}"), F.lit(points)).otherwise(0)
    return total


def score_label(score: Column) -> Column:
    return F.when(score >= 3, "conviction").when(score <= -3, "routine").otherwise("mixed")


def visible_days(rows: DataFrame, days: int = STATE_DAYS) -> DataFrame:
    """Each row on every day it is both filed and inside its window of ``days`` days from tx_date."""
    last = F.date_add("tx_date", days - 1)
    shown = rows.filter((F.col("filing_date") >= F.col("tx_date")) & (F.col("filing_date") <= last))
    return explode_days(shown, "filing_date", 0, "day", until=F.date_add("tx_date", days - 1))


def daily_state(rows: DataFrame) -> DataFrame:
    """(issuer, day) with owners, totals and role mix of the rows visible that day."""
    owners = visible_days(rows).groupBy("issuer", "day", "owner").agg(F.sum("value").alias("v"), F.max("is_director").alias("d"), F.max("is_officer").alias("o"), F.max("is_ten").alias("t"), F.max("pct").alias("p"), F.max("is_plan").alias("plan"), F.count("*").alias("n"))
    return owners.groupBy("issuer", "day").agg(
        F.count("*").alias("num_insiders"), F.sum("n").alias("num_tx"), F.sum("v").alias("total_value"), F.sum(F.col("d").cast("int")).alias("directors"),
        F.sum(F.col("o").cast("int")).alias("officers"), F.sum(F.col("t").cast("int")).alias("ten_pct"), F.max("p").alias("max_pct"), F.max("plan").alias("any_plan"),
    )


def episodes(state: DataFrame, calendar: DataFrame, qualifies: Column) -> DataFrame:
    """(issuer, event_day, idx): trading days that qualify while the previous trading day did not."""
    on = state.filter(qualifies).select("issuer", F.col("day").alias("date")).join(F.broadcast(calendar), "date")
    before = F.lag("idx").over(Window.partitionBy("issuer").orderBy("idx"))
    return on.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") < F.col("idx") - 1)).select("issuer", F.col("date").alias("event_day"), "idx")
