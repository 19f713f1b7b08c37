"""Window features over price bars; frames end before the row unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import trailing, upper_median, upper_middle

DAYS_A_YEAR = 252


def trailing_median(value: str, rows: int = 20) -> Column:
    """Upper median of the ``rows`` bars before this one; a shorter history counts."""
    return upper_middle(F.collect_list(value).over(trailing("issuer", "date", rows)))


def with_returns(bars: DataFrame) -> DataFrame:
    previous = F.lag("close").over(Window.partitionBy("issuer").orderBy("date"))
    return bars.withColumn("ret", F.when((F.col("close") > 0) & (previous > 0), F.col("close") / previous - 1))


def price_signals(bars: DataFrame) -> DataFrame:
    """momentum_20, vol_30 (11 closes at least) and distance from the 90-day high, strictly before the date."""
    by = Window.partitionBy("issuer").orderBy("date")
    high = Window.partitionBy("issuer").orderBy(F.unix_date("date")).rangeBetween(-90, -1)
    closes = F.count("close").over(trailing("issuer", "date", 31))
    vol = F.stddev_samp("ret").over(trailing("issuer", "date", 30)) * F.sqrt(F.lit(DAYS_A_YEAR))
    out = with_returns(bars)
    return out.select(
        "issuer", "date", F.try_divide(F.lag("close", 1).over(by), F.lag("close", 21).over(by)).alias("_m"), F.when(closes >= 11, vol).alias("vol_30"),
        (F.try_divide(F.lag("close", 1).over(by), F.max("high").over(high)) - 1).alias("from_high_90"),
    ).select("issuer", "date", (F.col("_m") - 1).alias("momentum_20"), "vol_30", "from_high_90")


def drawdown(rows: int) -> Column:
    """The last close over the highest of the last ``rows`` bars, minus 1; needs all of them."""
    w = trailing("issuer", "date", rows)
    last = F.lag("close", 1).over(Window.partitionBy("issuer").orderBy("date"))
    return F.when(F.count("close").over(w) == rows, last / F.max("close").over(w) - 1)


def momentum_skip(rows: int, skip: int = 5) -> Column:
    by = Window.partitionBy("issuer").orderBy("date")
    return F.try_divide(F.lag("close", skip + 1).over(by), F.lag("close", skip + 1 + rows).over(by)) - 1


def annual_volatility(rows: int) -> Column:
    """From ``rows`` simple returns; null if any is missing."""
    w = trailing("issuer", "date", rows)
    return F.when(F.count("ret").over(w) == rows, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(DAYS_A_YEAR)))


def to_average(rows: int) -> Column:
    w = trailing("issuer", "date", rows)
    last = F.lag("close", 1).over(Window.partitionBy("issuer").orderBy("date"))
    return F.when(F.count("close").over(w) == rows, last / F.avg("close").over(w))


def discontinuities(bars: DataFrame, factor: float = 3.0, rows: int = 20) -> DataFrame:
    """Bars whose close jumps by ``factor`` either way, with upper-median volumes before and from the bar on."""
    by = Window.partitionBy("issuer").orderBy("date")
    ratio = F.col("close") / F.lag("close").over(by)
    jumps = bars.withColumn("ratio", ratio).withColumn("volume_before", upper_median(F.collect_list("volume").over(by.rowsBetween(-rows, -1)))).withColumn("volume_after", upper_median(F.collect_list("volume").over(by.rowsBetween(0, rows - 1))))
    return jumps.filter((F.col("ratio") >= factor) | (F.col("ratio") <= 1 / factor)).withColumn("volume_ratio", F.try_divide("volume_after", "volume_before"))


#: Usual split ratios.
SPLIT_RATIOS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 50, 100)


def classify_split(ratio: str = "ratio", volume_ratio: str = "volume_ratio", tolerance: float = 1.10) -> Column:
    """split, real_move or ambiguous: nearness to a usual ratio in log space, then how volume moved against it."""
    gap = F.array_min(F.array(*[F.abs(F.log(F.col(ratio)) - F.log(F.lit(float(r) ** s))) for r in SPLIT_RATIOS for s in (1, -1)]))
    near = gap <= F.log(F.lit(tolerance))
    against = F.when(F.col(ratio) > 1, F.col(volume_ratio) <= 0.8).otherwise(F.col(volume_ratio) >= 1.25)
    return F.when(near & against, "split").when(~near & ~F.coalesce(against, F.lit(False)), "real_move").otherwise("ambiguous")


def back_adjust(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars with prices multiplied, and volume divided, by the factors of all later splits (issuer, date, factor)."""
    after = Window.partitionBy("issuer").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    joined = bars.join(splits.select("issuer", "date", "factor"), ["issuer", "date"], "left")
    factor = F.exp(F.coalesce(F.sum(F.log(F.coalesce("factor", F.lit(1.0)))).over(after), F.lit(0.0)))
    out = joined.withColumn("_f", factor)
    for c in ("open", "high", "low", "close"):
        out = out.withColumn(c, F.col(c) * F.col("_f"))
    return out.withColumn("volume", F.col("volume") / F.col("_f")).withColumn("dollar_volume", F.col("close") * F.col("volume")).drop("_f", "factor")
