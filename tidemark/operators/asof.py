"""As-of and positional joins on sorted keys.

An as-of join is a union of both sides and one window over the key: no inequality join, no
row explosion, one shuffle by key. Facts win or lose ties with probes by the ``strict`` flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(probes: DataFrame, facts: DataFrame, *, by: list[str], probe_on: str, fact_on: str, values: list[str], strict: bool = False, tolerance: int | None = None, forward: bool = False) -> DataFrame:
    """``probes`` with the ``values`` and date (``asof_date``) of the latest fact on or before each probe.

    ``strict``: before the probe only. ``tolerance``: facts older than so many days don't count.
    ``forward``: the earliest fact on or after (``strict``: after) instead. Facts with a null
    date or a null in all values are skipped. Of facts of one date the last by values wins.
    """
    valid = F.col(fact_on).isNotNull() & ~F.lit(True)
    for v in values:
        valid = valid | F.col(v).isNotNull()
    fact = F.struct(F.col(fact_on).alias("asof_date"), *[F.col(v) for v in values])
    # facts stand before probes of the same date unless strict (mirrored when looking forward)
    rank_fact = 1 if strict else -1
    left = probes.select(F.struct("*").alias("_probe"), *[F.col(b).alias(f"_k_{b}") for b in by], F.col(probe_on).alias("_on"), F.lit(0).alias("_rank"), F.lit(None).cast(facts.select(fact.alias("x")).schema["x"].dataType).alias("_fact"))
    right = facts.filter(valid & F.col(fact_on).isNotNull()).select(F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), *[F.col(b).alias(f"_k_{b}") for b in by], F.col(fact_on).alias("_on"), F.lit(rank_fact).alias("_rank"), fact.alias("_fact"))
    order = [F.col("_on").desc(), F.col("_rank"), F.col("_fact").desc()] if forward else [F.col("_on"), F.col("_rank"), F.col("_fact")]
    window = Window.partitionBy(*[f"_k_{b}" for b in by]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_hit", F.last("_fact", ignorenulls=True).over(window)).filter(F.col("_probe").isNotNull())
    hit = F.col("_hit")
    if tolerance is not None:
        hit = F.when(F.abs(F.datediff(F.col("_on"), F.col("_hit.asof_date"))) <= tolerance, hit)
    return found.withColumn("_hit", hit).select("_probe.*", "_hit.*")


def positional(probes: DataFrame, calendar: DataFrame, *, idx: str, offset: int, name: str) -> DataFrame:
    """``probes`` with the calendar date ``offset`` positions after ``idx``; null past the end."""
    days = calendar.select((F.col("idx") - offset).alias(idx), F.col("date").alias(name))
    return probes.join(F.broadcast(days), idx, "left")  # a calendar has one row a trading day
