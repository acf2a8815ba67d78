"""Grand totals, shares, scaling and top-n without unpartitioned windows or cross joins.

A grand total is a one-row scalar subquery: Spark computes it once and reuses the shuffle of the frame
it is taken from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col, ratio


def totals(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over the whole frame as one struct column; meant to be used once per plan."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("totals")).scalar()


def with_totals(df: DataFrame, source: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """Add the aggregates of `source` (df itself by default) to every row as the struct `totals`.

    The struct is one column, so however often its fields are read there is one subquery to plan.
    """
    return df.withColumn("totals", totals(df if source is None else source, **aggregates))


# Relative width below which a range counts as constant: 1000 times the double precision step.
FLAT = 1000 * 2.0**-52


def rescale(c: Column | str, low: Column, high: Column) -> Column:
    """Map low..high to 0..1; a constant range gives 0.5 and a null stays null."""
    c = col(c)
    nearest = F.least(F.abs(low), F.abs(high))
    flat = (low == high) | ((nearest != 0) & (F.abs(ratio(low - high, nearest)) < FLAT))
    return F.when(c.isNotNull() & flat, F.lit(0.5)).otherwise(ratio(c - low, high - low))


def standardise(c: Column | str, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in standard deviations; null when there is no spread."""
    return ratio(col(c) - mean, deviation)


def top_n(df: DataFrame, measure: str, n: int) -> DataFrame:
    """The n rows with the largest measure, plus every row tied with the last of them; nulls last.

    The n-th value comes from a distributed top-n, so no window over the whole frame is needed.
    """
    best = df.select(measure).orderBy(F.desc_nulls_last(measure)).limit(n)
    everything = F.lit(float("-inf"))
    reaches_nulls = (F.count(F.lit(1)) < n) | (F.count(measure) < F.count(F.lit(1)))
    cut = best.agg(F.when(reaches_nulls, everything).otherwise(F.min(measure))).scalar()
    return df.where(F.coalesce(col(measure), everything) >= cut)
