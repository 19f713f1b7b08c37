"""Range joins as equi joins on date bins.

A row of the facts falls into one bin of ``width`` days; a probe looks into the bins that its
window touches (two, if the window is no longer than the bin). The exact bounds are
filtered afterwards, so rows are never paired beyond neighbouring bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(probes: DataFrame, facts: DataFrame, *, by: list[str], probe_on: str, fact_on: str, before: int, after: int = 0, condition: Column | None = None, how: str = "inner", key: list[str] | None = None) -> DataFrame:
    """Pairs with fact_on in [probe_on - before, probe_on + after] and equal ``by`` columns.

    Facts' columns must not clash with the probes' except for ``by``. ``how`` may be inner or left. Probes without a
    fact come back by ``key``, columns that tell probes apart (all unless named), which a
    second evaluation of the probes gives alike; a probe that occurs twice comes back twice.
    """
    width = max(1, before + after + 1)
    bin_of = lambda c: F.floor(F.unix_date(c) / width)
    low, high = bin_of(F.date_sub(F.col(probe_on), before)), bin_of(F.date_add(F.col(probe_on), after))
    binned = probes.withColumn("_bin", F.explode(F.sequence(low, high)))
    right = facts.withColumn("_bin", bin_of(F.col(fact_on)))
    gap = F.datediff(F.col(fact_on), F.col(probe_on))
    exact = (gap >= -before) & (gap <= after)
    pairs = binned.join(right, [*by, "_bin"]).filter(exact if condition is None else exact & condition).drop("_bin")
    if how == "inner":
        return pairs
    new = [f for f in facts.schema.fields if f.name not in by]
    names = key or probes.columns
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in names]
    met = pairs.select(*names).distinct()
    alone = probes.alias("p").join(met.alias("m"), same, "left_anti").select("p.*")
    return pairs.select(*probes.columns, *[f.name for f in new]).unionByName(alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new]))


def explode_days(rows: DataFrame, start: str, days: int, name: str = "day", until: Column | None = None) -> DataFrame:
    """A row for each of ``days`` days from ``start``: inverts a band join into an equi join on the day."""
    end = F.date_add(F.col(start), days - 1) if until is None else until
    return rows.withColumn(name, F.explode(F.sequence(F.col(start), end)))
