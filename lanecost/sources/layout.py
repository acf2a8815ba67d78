"""Orders and a large rate card stored by lane, so that they join without a shuffle.

`write_orders` keeps orders in a folder for each day, cut into buckets by lane; `write_card` keeps the three tables of a
rate card, cut into as many buckets by the same lane. A period then reads the folders of its days, and each bucket of
orders meets its bucket of the card where it lies. The tables are tables of the session's catalog, since Spark records
buckets there.

The lane is one text column, in which a missing key has a mark of its own, so that it joins by plain equality and still
matches a missing key. The joins also compare the range of weights and the lower bound. Spark accepts buckets by the lane
alone for them if `CO_PARTITION` is off; `session_settings` says so.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import band_label, band_text
from ..operators import rating

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
LANE = "lane"
DAY = "order_date"
PARTS = ("lanes", "segments", "rates")
MISSING, PRESENT = "-", "+"


def session_settings() -> dict[str, str]:
    """Settings under which the stored tables join without a shuffle."""
    return {CO_PARTITION: "false"}


def lane_text(columns: Sequence[str]) -> Column:
    """The keys of a lane as one text; every key has its length before it, so no two lanes share a text."""

    def part(c: str) -> Column:
        held = F.concat(F.lit(PRESENT), F.length(c).cast("string"), F.lit(":"), F.col(c))
        return F.coalesce(held, F.lit(MISSING))

    return F.concat(*[part(c) for c in columns])


def write_orders(orders: DataFrame, table: str, buckets: int) -> None:
    """Store orders by day and by buckets of lanes, one file for each bucket of a day."""
    laned = orders.withColumn(LANE, lane_text([o for o, _ in rating.LANE]))
    spread = laned.repartition(buckets, LANE)
    spread.write.mode("overwrite").partitionBy(DAY).bucketBy(buckets, LANE).sortBy(LANE).saveAsTable(table)


def write_card(rates: DataFrame, table: str, buckets: int, ties: str = "all") -> None:
    """Store a rate card as <table>_lanes (where the ranges of a lane begin), <table>_segments (the lower bound that wins
    at each weight) and <table>_rates (the rates by lower bound)."""
    keys = [k for _, k in rating.LANE]
    lanes = rating.lane_ranges(rates)
    card = rating.rates_by_bound(rates, ties)
    card = card.withColumn("weight_band", band_label(band_text("minm_wgh_qty", "max_wgh_qty")))
    parts = {"lanes": lanes, "segments": rating.winning_bounds(rates, lanes), "rates": card}
    for name, part in parts.items():
        laned = part.withColumn(LANE, lane_text(keys)).drop(*keys).repartition(buckets, LANE)
        laned.write.mode("overwrite").bucketBy(buckets, LANE).sortBy(LANE).saveAsTable(f"{table}_{name}")


def rated_orders(
    spark: SparkSession, orders: str, card: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Stored orders of a period with their best rates, as `rating.rate_orders` has them where ids are unique."""
    days = spark.table(orders)
    if first is not None:
        days = days.where(F.col(DAY) >= F.lit(first))
    if last is not None:
        days = days.where(F.col(DAY) <= F.lit(last))
    lanes, segments, rates = (spark.table(f"{card}_{p}") for p in PARTS)
    placed = days.join(lanes, LANE).withColumn("range", rating.range_of(F.col("edges"), F.col("weight"))).drop("edges")
    bounded = placed.alias("o").join(
        segments.alias("s"),
        (F.col("o.lane") == F.col("s.lane"))
        & (F.col("o.range") == F.col("s.range"))
        & rating.segment_holds_weight(placed, segments),
    )
    bounded = bounded.select("o.*", "s.low").drop("range")
    rated = bounded.alias("o").join(
        rates.alias("r"),
        (F.col("o.lane") == F.col("r.lane"))
        & (F.col("o.low") == F.col("r.minm_wgh_qty"))
        & rating.rate_holds_weight(bounded, rates),
    )
    rated = rated.select("o.*", *[F.col(f"r.{c}") for c in rates.columns if c not in (LANE, "above")])
    rated = rated.withColumn("gap", F.abs(F.col("weight") - F.col("low"))).drop("low", LANE)
    return rated.withColumn("shipping_cost", rating.freight_cost())
