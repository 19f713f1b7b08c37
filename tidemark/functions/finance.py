"""Return, cost and risk formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_excess(own: Column, other: Column) -> Column:
    """log1p of both returns, floored at -0.999, subtracted; null if either is missing."""
    floor = lambda r: F.when(r.isNotNull(), F.log1p(F.greatest(r, F.lit(-0.999))))
    return floor(own) - floor(other)


def cost_bps(price: Column, dollar_volume: Column, position: Column) -> Column:
    """Half spread from price and volume, 5 to 400, and twice the square-root impact; null when unusable."""
    spread = F.greatest(F.lit(5.0), F.least(F.lit(400.0), 4 / F.sqrt(price) + 20 / F.sqrt(dollar_volume / 1e6)))
    return F.when((price > 0) & (dollar_volume > 0), spread + 2 * 200 * F.sqrt(position / dollar_volume))


def annualise(mean: Column, periods: float) -> Column:
    return F.pow(1 + mean, F.lit(float(periods))) - 1


def sharpe_label(value: Column, vol: Column) -> Column:
    """The value over volatility, which counts as 0.10 at least."""
    return F.when(vol.isNotNull(), value / F.greatest(vol, F.lit(0.10)))
