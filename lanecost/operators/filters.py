"""User filters on the marts and the orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ALL = "All"


@dataclass(frozen=True)
class FilterSpec:
    """Chosen warehouse, carrier and service level; "All" or None passes everything.

    Warehouses are plant codes while shipping rows carry port codes. By default a plant is mapped to
    its port; with map_keys=False the two are compared as they stand.
    """

    warehouse: str | None = ALL
    carrier: str | None = ALL
    service_level: str | None = ALL
    map_keys: bool = True

    def origin(self) -> str | None:
        if self.map_keys and self.warehouse:
            return self.warehouse.replace("PLANT", "PORT", 1)
        return self.warehouse

    def text(self) -> str:
        return "; ".join(
            f"{name}={value or ALL}"
            for name, value in (
                ("warehouse", self.warehouse),
                ("carrier", self.carrier),
                ("service_level", self.service_level),
            )
        )


def is_chosen(value: str | None) -> bool:
    return value is not None and value != ALL


def _keep(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if is_chosen(value):
            df = df.where(F.col(column) == value)
    return df


def filter_shipping(shipping: DataFrame, spec: FilterSpec) -> DataFrame:
    return _keep(shipping, origin_port=spec.origin(), carrier=spec.carrier)


def filter_orders(orders: DataFrame, spec: FilterSpec) -> DataFrame:
    return _keep(
        orders,
        plant_code=spec.warehouse,
        carrier=spec.carrier,
        service_level=spec.service_level,
    )


def plants_served(orders: DataFrame, carrier: str) -> DataFrame:
    """Plants a carrier has orders at. Distinct before the join: the orders shrink to a few rows."""
    return orders.where(F.col("carrier") == carrier).select("plant_code").distinct()


def filter_plants(df: DataFrame, spec: FilterSpec, orders: DataFrame | None = None) -> DataFrame:
    """Filter a plant-level mart by plant and, when orders are given, by the plants a carrier serves."""
    df = _keep(df, plant_code=spec.warehouse)
    if orders is not None and is_chosen(spec.carrier):
        served = plants_served(orders, spec.carrier).withColumnRenamed("plant_code", "served_plant")
        df = df.join(served, F.col("plant_code").eqNullSafe(F.col("served_plant")), "left_semi")
    return df


def filter_choices(orders: DataFrame) -> DataFrame:
    """Values offered per filter: "All" first, then the distinct values in order."""
    columns = {"warehouse": "plant_code", "carrier": "carrier", "service_level": "service_level"}
    pairs = F.array(
        *[F.struct(F.lit(n).alias("filter"), F.col(c).alias("choice")) for n, c in columns.items()]
    )
    heads = F.array(
        *[F.struct(F.lit(n).alias("filter"), F.lit(ALL).alias("choice")) for n in columns]
    )
    values = (
        orders.select(*columns.values())
        .distinct()
        .select(F.inline(pairs))
        .where(F.col("choice").isNotNull())
        .distinct()
        .withColumn("position", F.lit(1))
    )
    first = (
        orders.sparkSession.range(1)
        .select(F.inline(heads))
        .withColumn("position", F.lit(0))
    )
    return first.unionByName(values).orderBy("filter", "position", "choice")


def filter_audit(df: DataFrame, kept: Column, spec: FilterSpec) -> DataFrame:
    """Selections of a filter with the row counts before and after it, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
    ).select(F.lit(spec.text()).alias("filters_applied"), "rows_before", "rows_after")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with a row count that is filled in by whatever action runs on it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
