"""Source schemas and the fixed code domains."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


TEXT, NUMBER, INT, LONG = StringType(), DoubleType(), IntegerType(), LongType()

ORDER_LIST = _schema(
    order_id=LONG,
    order_date=DateType(),
    origin_port=TEXT,
    carrier=TEXT,
    tpt=INT,
    service_level=TEXT,
    ship_ahead_day_count=INT,
    ship_late_day_count=INT,
    customer=TEXT,
    product_id=LONG,
    plant_code=TEXT,
    destination_port=TEXT,
    unit_quantity=NUMBER,
    weight=NUMBER,
)

FREIGHT_RATES = _schema(
    orig_port_cd=TEXT,
    dest_port_cd=TEXT,
    carrier=TEXT,
    svc_cd=TEXT,
    mode_dsc=TEXT,
    minm_wgh_qty=NUMBER,
    max_wgh_qty=NUMBER,
    rate=NUMBER,
    minimum_cost=NUMBER,
)

WH_COSTS = _schema(wh=TEXT, cost_unit=NUMBER, year=INT, month=INT)

WH_CAPACITIES = _schema(plant_id=TEXT, daily_capacity=NUMBER, region=TEXT, type=TEXT, status=TEXT)

SCHEMAS = {
    "order_list": ORDER_LIST,
    "freight_rates": FREIGHT_RATES,
    "wh_costs": WH_COSTS,
    "wh_capacities": WH_CAPACITIES,
}

# The codes and weight bands the data model allows. The band order is the sort order.
SERVICE_LEVELS = ("CRF", "DTD", "DTP")
MODES = ("AIR", "GROUND")
WEIGHT_BANDS = (
    "0 - 99.99",
    "0.01 - 0.5",
    "0.51 - 1",
    "1.01 - 1.5",
    "1.51 - 2",
    "2.01 - 2.5",
    "70.51 - 99.99",
    "100 - 249.99",
    "100 - 299.99",
    "250 - 499.99",
    "300 - 499.99",
    "500 - 1999.99",
    "0 - 5000",
)
