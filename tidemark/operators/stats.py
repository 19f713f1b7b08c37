"""Ranks, quantile bins, medians and tests as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """Of an array: the element at n // 2 of the sorted values, no averaging."""
    return upper_middle(F.filter(values, lambda v: v.isNotNull()))


def upper_middle(values: Column) -> Column:
    """``upper_median`` of an array without nulls, as ``collect_list`` makes it; no lambda runs for its elements."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def exact_sum(value: str) -> Column:
    """Sum of doubles that doesn't depend on the order of rows where they have up to 8 decimals, so equal amounts tie.

    Decimals add up exactly; what they can't hold (more decimals, amounts from 1e12 on, NaN) is summed as doubles beside them.
    """
    v = F.col(value).cast("double")
    part = F.when(F.abs(v) < 1e12, v.cast("decimal(20,8)"))
    rest = F.when(part.isNotNull(), v - part.cast("double")).otherwise(v)
    return F.coalesce(F.sum(part).cast("double"), F.when(F.count(v) > 0, F.lit(0.0))) + F.sum(rest)


def medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): exact medians of groups of any size, nulls left out; ``rows`` are read three times.

    Approximate quantiles on both sides of the middle (their error is a hundredth of the gap) leave few values
    between them; only these are sorted. ``F.median`` would hold all of a group's distinct values in one task.
    """
    key, some = by or ["_all"], rows.filter(F.col(value).isNotNull()).select(*(by or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    edges = F.percentile_approx("_v", F.array(F.lit(0.49), F.lit(0.51)), F.lit(10_000))
    bounds = some.groupBy(*key).agg(F.count("*").alias("_n"), edges.alias("_e")).select(*key, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    cut = some.join(F.broadcast(bounds), key)
    below = cut.groupBy(*key).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    middle = cut.filter("_v BETWEEN _lo AND _hi").groupBy(*key, "_n", "_v").agg(F.count("*").alias("_times"))
    upto = F.sum("_times").over(Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = middle.join(F.broadcast(below), key).withColumn("_to", F.col("_below") + upto).withColumn("_from", F.col("_to") - F.col("_times"))
    at = lambda k: F.max(F.when((F.col("_from") < k) & (k <= F.col("_to")), F.col("_v")))
    found = ranked.groupBy(*key).agg(at(F.floor((F.col("_n") + 1) / 2)).alias("_a"), at(F.floor(F.col("_n") / 2) + 1).alias("_b"))
    median = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2)
    return found.select(*by, F.when(F.isnull("_a") | F.isnull("_b"), F.raise_error(F.lit("the middle lies outside its bounds")).cast("double")).otherwise(median).alias("median"))


def percent_rank_average(value: str, partition: list[str]) -> Column:
    """Average-tie rank over the count of non-null values; null for nulls."""
    same = Window.partitionBy(*partition, value)
    below = Window.partitionBy(*partition).orderBy(F.col(value).asc_nulls_last())
    everything = Window.partitionBy(*partition)
    first = F.rank().over(below)
    return F.when(F.col(value).isNotNull(), (first + (F.count(value).over(same) - 1) / 2) / F.count(value).over(everything))


def qcut_edges(rows: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """(by, edges): inner quantile edges by linear interpolation, duplicates merged with the ends."""
    points = [k / bins for k in range(bins + 1)]
    return rows.groupBy(*by).agg(F.array_distinct(F.percentile(value, F.lit(points))).alias("edges"))


def qcut(rows: DataFrame, value: str, bins: int, by: list[str], name: str = "bucket") -> DataFrame:
    """Right-closed bins, the lowest edge included: bucket 0, 1, ... ; null for a null value."""
    with_edges = rows.join(qcut_edges(rows, value, bins, by), by, "left") if by else rows.crossJoin(F.broadcast(qcut_edges(rows, value, bins, by)))
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return with_edges.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("edges")


def t_stat(value: str) -> Column:
    """One-sample t of the mean against 0; null for fewer than two values or no spread."""
    return F.try_divide(F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value)))


def trailing(partition: str, order: str, rows: int, end: int = -1) -> WindowSpec:
    """``rows`` rows ending ``-end`` rows before the current one."""
    return Window.partitionBy(partition).orderBy(order).rowsBetween(end - rows + 1, end)


def counts_before(counts: DataFrame, value: str, count: str, parts: int = 64) -> DataFrame:
    """``counts`` with ``before``, the sum of ``count`` over smaller values, without a global window.

    Values (distinct) are cut at quantiles; sums of the parts run over ``parts`` rows, the rest inside each part.
    """
    edges = sorted(set(counts.approxQuantile(value, [k / parts for k in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.lit(edges), lambda e: e < F.col(value))) if edges else F.lit(0)
    parted = counts.withColumn("_part", part)
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("_part").agg(F.sum(count).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(past(Window.orderBy("_part"))), F.lit(0)))
    inner = F.coalesce(F.sum(count).over(past(Window.partitionBy("_part").orderBy(value))), F.lit(0))
    return parted.withColumn("_inner", inner).join(F.broadcast(base.drop("_sum")), "_part").withColumn("before", F.col("_base") + F.col("_inner")).drop("_part", "_base", "_inner")
