"""Summaries of the warehouse marts: storage ranking, capacity, breakdown, quadrants, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col, lenient_sum, percent, ratio, strict, strict_sum
from ..functions.text import comma_text, port_to_plant, replace_first, share_text, title
from ..operators.totals import rescale, standardise, top_n, with_totals


def storage_ranking(costs: DataFrame, n: int = 10) -> DataFrame:
    """The n plants with the largest storage cost, ties kept; shares are of the plants shown."""
    shown = top_n(costs, "storage_cost", n)
    df = with_totals(shown, cost=strict_sum("storage_cost"))
    return df.withColumn("pct_of_total", percent("storage_cost", "totals.cost")).drop("totals")


def storage_ranking_of_all(costs: DataFrame, n: int = 10) -> DataFrame:
    """The same ranking with shares of all plants, cost per unit and units per unit of cost."""
    full = with_totals(costs, cost=strict_sum("storage_cost")).withColumns(
        {
            "cost_per_unit": ratio("storage_cost", "total_units"),
            "efficiency_score": ratio("total_units", "storage_cost"),
            "pct_of_total": percent("storage_cost", "totals.cost"),
        }
    )
    return top_n(full.drop("totals"), "storage_cost", n)


def storage_export(costs: DataFrame) -> DataFrame:
    """All plants, largest storage cost first."""
    return costs.orderBy(F.desc_nulls_last("storage_cost")).select(
        "plant_code", "storage_cost", "total_units", "cost_per_unit"
    )


def capacity_status(capacity: DataFrame) -> DataFrame:
    """Utilisation in percent; at or above capacity counts as over, an unknown one as under."""
    over = F.col("capacity_utilization") >= 1
    share = share_text("capacity_utilization")
    return capacity.withColumns(
        {
            "utilization_pct": F.col("capacity_utilization") * 100,
            "status": F.when(over, F.lit("Over Capacity")).otherwise(F.lit("Under Capacity")),
            "util_label": share,
            "detail_label": F.concat(share, F.lit("\n"), comma_text("n"), F.lit(" orders")),
        }
    )


def _storage_per_plant(costs: DataFrame, *, skip_missing: bool) -> DataFrame:
    """One storage cost per plant (the earliest cost row) and the number of its cost rows."""
    stamp = [c for c in ("year", "month") if c in costs.columns]
    when = F.struct(*stamp, "storage_cost")
    if skip_missing:
        when = F.when(F.col("storage_cost").isNotNull(), when)
    return costs.groupBy(F.col("plant_code").alias("cost_plant")).agg(
        F.min_by("storage_cost", when).alias("storage_cost"),
        F.count(F.lit(1)).alias("cost_rows"),
    )


def cost_breakdown_chart(shipping: DataFrame, costs: DataFrame) -> DataFrame:
    """Transport and storage cost per plant in long form, with shares of the grand total.

    A missing storage cost makes every share missing. A plant with k cost rows counts its transport k
    times, as the plain join of the two marts would.
    """
    transport = shipping.groupBy(port_to_plant("origin_port").alias("plant_code")).agg(
        strict_sum("total_shipping_cost").alias("transport")
    )
    storage = _storage_per_plant(costs, skip_missing=False)
    wide = transport.join(
        storage, transport["plant_code"].eqNullSafe(storage["cost_plant"]), "left"
    ).select(
        "plant_code",
        (F.col("transport") * F.coalesce("cost_rows", F.lit(1))).alias("transport_cost"),
        "storage_cost",
    )
    wide = wide.withColumn("total_cost", F.col("transport_cost") + F.col("storage_cost"))
    long = wide.unpivot(
        ["plant_code", "total_cost"], ["transport_cost", "storage_cost"], "cost_type", "amount"
    )
    return with_totals(long, amount=strict_sum("amount")).select(
        "plant_code",
        "total_cost",
        title("cost_type").alias("cost_type"),
        "amount",
        percent("amount", "totals.amount").alias("pct_of_total"),
    )


def cost_breakdown_export(shipping: DataFrame, costs: DataFrame, *, map_keys: bool = True) -> DataFrame:
    """Transport and storage cost per origin in wide form, with shares of the origin's total.

    With map_keys=False the origin port is compared with the plant code as it stands.
    """
    plant = port_to_plant("origin_port") if map_keys else F.col("origin_port")
    transport = (
        shipping.groupBy("origin_port")
        .agg(lenient_sum("total_shipping_cost").alias("transport"))
        .withColumn("plant", plant)
    )
    storage = _storage_per_plant(costs, skip_missing=True)
    wide = transport.join(
        storage, transport["plant"].eqNullSafe(storage["cost_plant"]), "left"
    ).select(
        "origin_port",
        (F.col("transport") * F.coalesce("cost_rows", F.lit(1))).alias("transport_cost"),
        "storage_cost",
    )
    total = F.col("total_cost")

    def share(c: str) -> Column:
        return F.when(total > 0, percent(c, total)).when(total <= 0, F.lit(0.0))

    return wide.withColumn(
        "total_cost", F.col("transport_cost") + F.col("storage_cost")
    ).withColumns({"pct_transport": share("transport_cost"), "pct_storage": share("storage_cost")})


def _quadrant(unit: Column, kg: Column) -> Column:
    """Class against the two medians; anything unknown falls into the last class."""
    high_unit, high_kg = F.col("cost_per_unit") >= unit, F.col("cost_per_kg") >= kg
    low_unit, low_kg = F.col("cost_per_unit") < unit, F.col("cost_per_kg") < kg
    return (
        F.when(high_unit & high_kg, F.lit("High Cost"))
        .when(low_unit & low_kg, F.lit("Optimal"))
        .when(high_unit & low_kg, F.lit("High Unit Cost"))
        .otherwise(F.lit("High KG Cost"))
    )


def unit_cost_quadrants(costs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Plants classed by cost per unit and per kg against the medians of `base`.

    The chart takes the medians of all plants (base = the unfiltered mart), the export those of the
    rows it shows (base left out). The exact median keeps the distinct values of its input: that is
    the plant mart, one row per plant, never the orders.
    """
    base = costs if base is None else base
    df = with_totals(
        costs, base, unit=strict(F.median, "cost_per_unit"), kg=strict(F.median, "cost_per_kg")
    )
    return df.select(
        "plant_code",
        "cost_per_unit",
        "cost_per_kg",
        "total_units",
        "total_orders",
        _quadrant(F.col("totals.unit"), F.col("totals.kg")).alias("quadrant"),
    )


SCORES = {
    "storage_efficiency": "storage_cost",
    "unit_cost_efficiency": "cost_per_unit",
    "kg_cost_efficiency": "cost_per_kg",
}


def _total(name: str) -> Column:
    return F.col(f"totals.{name}")


def efficiency_matrix_export(costs: DataFrame) -> DataFrame:
    """Scores from 0 to 1 per plant, wide: low costs and high volume score high."""
    df = with_totals(
        costs,
        **{f"low_{c}": F.min(c) for c in (*SCORES.values(), "total_units")},
        **{f"high_{c}": F.max(c) for c in (*SCORES.values(), "total_units")},
    )
    scores = [
        rescale(-col(c), -_total(f"high_{c}"), -_total(f"low_{c}")).alias(score)
        for score, c in SCORES.items()
    ]
    volume = rescale("total_units", _total("low_total_units"), _total("high_total_units"))
    return df.select("plant_code", *scores, volume.alias("volume_efficiency"))


# The score from which a class applies; a lower or missing score needs improvement.
CLASSES = {"Excellent": 0.75, "Good": 0.50, "Fair": 0.25}


def performance(score: Column | str) -> Column:
    names = [F.when(col(score) >= least, F.lit(name)) for name, least in CLASSES.items()]
    return F.coalesce(*names, F.lit("Needs Improvement"))


def efficiency_matrix_chart(costs: DataFrame) -> DataFrame:
    """Scores in long form with a class; one missing cost makes that whole metric missing."""
    df = with_totals(
        costs,
        **{f"low_{c}": strict(F.min, c) for c in SCORES.values()},
        **{f"high_{c}": strict(F.max, c) for c in SCORES.values()},
        low_units=F.min("total_units"),
        high_units=F.max("total_units"),
    )
    scores = [
        rescale(
            _total(f"high_{c}") - col(c),
            F.lit(0.0),
            _total(f"high_{c}") - _total(f"low_{c}"),
        ).alias(score)
        for score, c in SCORES.items()
    ]
    volume = rescale("total_units", _total("low_units"), _total("high_units"))
    wide = df.select("plant_code", *scores, volume.alias("volume_efficiency"))
    metric = title(replace_first("metric", "_efficiency", ""))
    return (
        wide.unpivot(["plant_code"], [*SCORES, "volume_efficiency"], "metric", "score")
        .withColumn("metric", metric)
        .withColumn("performance", performance("score"))
    )


def standardised_costs(costs: DataFrame) -> DataFrame:
    """Plant costs with their z-scores in long form."""
    scores = {
        "storage_efficiency": "storage_cost",
        "unit_efficiency": "cost_per_unit",
        "kg_efficiency": "cost_per_kg",
    }
    df = with_totals(
        costs,
        **{f"mean_{c}": F.avg(c) for c in scores.values()},
        **{f"sd_{c}": F.stddev_samp(c) for c in scores.values()},
    )
    keep = ["plant_code", *scores.values()]
    wide = df.select(
        *keep,
        *[
            standardise(c, _total(f"mean_{c}"), _total(f"sd_{c}")).alias(score)
            for score, c in scores.items()
        ],
    )
    return wide.unpivot(keep, list(scores), "metric", "score")
