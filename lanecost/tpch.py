"""Derive the four supply-chain tables from TPC-H-like Parquet tables.

One order-list row per order that has line items. The dimension joins are left joins on primary keys,
so leaving one out changes no row; each caller names the columns it reads and only the joins that
serve them are made. Catalyst and AQE choose how each join runs, from sizes and with skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.schemas import FREIGHT_RATES, ORDER_LIST, WH_CAPACITIES, WH_COSTS
from .sources.tables import SupplyTables

# The columns read here. A declared schema spares Spark a job per file to find it out.
COLUMNS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_size int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "nation": "n_nationkey int",
}

# Carrier, mode, band and base rate of the made rate card. They include a nested band,
# ties, gaps and one exact duplicate; carrier V44_3 has no rates.
BANDS = (
    ("V44_1", "AIR", 0.0, 99.99, 4.0),
    ("V44_1", "AIR", 100.0, 249.99, 3.0),
    ("V44_1", "GROUND", 250.0, 499.99, 1.0),
    ("V44_1", "GROUND", 500.0, 1999.99, 0.5),
    ("V44_2", "AIR", 0.0, 99.99, 4.5),
    ("V44_2", "GROUND", 100.0, 299.99, 1.5),
    ("V44_2", "GROUND", 300.0, 499.99, 1.2),
    ("V44_2", "GROUND", 0.0, 5000.0, 2.0),
    ("V44_4", "AIR", 0.0, 5000.0, 5.0),
    ("V44_4", "GROUND", 0.0, 5000.0, 2.0),
    ("V44_5", "AIR", 2.01, 2.5, 9.0),
    ("V44_5", "AIR", 70.51, 99.99, 6.0),
    ("V44_5", "AIR", 70.51, 99.99, 6.0),
)


def _code(prefix: str, nation_key: str) -> str:
    return f"concat('{prefix}', lpad(cast({nation_key} + 1 as string), 2, '0'))"


_CARRIER = "concat('V44_', substr(o_orderpriority, 1, 1))"
_DELAY = "datediff(cast(sd as date), cast(o_orderdate as date))"

ORDER_EXPRESSIONS = {
    "order_id": "o_orderkey + 1",
    "order_date": "cast(o_orderdate as date)",
    "origin_port": _code("PORT", "s_nationkey"),
    "carrier": _CARRIER,
    "tpt": "p_size % 3 + 1",
    "service_level": (
        f"CASE WHEN {_CARRIER} = 'V44_3' THEN 'CRF' WHEN o_orderstatus = 'F' THEN 'DTD' "
        "WHEN o_orderstatus = 'O' THEN 'DTP' WHEN o_orderstatus = 'P' THEN 'CRF' END"
    ),
    "ship_ahead_day_count": f"greatest(-{_DELAY}, 0)",
    "ship_late_day_count": f"greatest({_DELAY}, 0)",
    "customer": "c_name",
    "product_id": "pk + 1",
    "plant_code": _code("PLANT", "s_nationkey"),
    "destination_port": _code("PORT", "c_nationkey % 5"),
    "unit_quantity": "q",
    "weight": "q * p_size / 10",
}

# Dimension table: its join condition and the order columns that need it.
DIMENSIONS = {
    "supplier": ("sk = s_suppkey", {"origin_port", "plant_code"}),
    "part": ("pk = p_partkey", {"weight", "tpt"}),
    "customer": ("o_custkey = c_custkey", {"customer", "destination_port"}),
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


def order_list(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    columns = ORDER_LIST.names if columns is None else columns
    lines = (
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.expr("sum(l_quantity) AS q"),
            F.expr("min(l_suppkey) AS sk"),
            F.expr("min(l_partkey) AS pk"),
            F.expr("min(l_shipdate) AS sd"),
        )
    )
    df = _read(spark, sf_dir, "orders").join(lines, F.expr("o_orderkey = l_orderkey"))
    for table, (condition, serves) in DIMENSIONS.items():
        if serves & set(columns):
            df = df.join(_read(spark, sf_dir, table), F.expr(condition), "left")
    return df.selectExpr(
        *[
            f"cast({ORDER_EXPRESSIONS[c]} as {ORDER_LIST[c].dataType.simpleString()}) AS {c}"
            for c in columns
        ]
    )


def freight_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every band row for every origin nation, five destinations and both rated service levels."""
    bands = ", ".join(
        f"named_struct('carrier', '{carrier}', 'mode_dsc', '{mode}', 'minm_wgh_qty', {low}D, "
        f"'max_wgh_qty', {high}D, 'base', {base}D)"
        for carrier, mode, low, high, base in BANDS
    )
    made = {
        "orig_port_cd": _code("PORT", "n_nationkey"),
        "dest_port_cd": _code("PORT", "dest"),
        "rate": "base * (1 + n_nationkey % 4) / 10",
        "minimum_cost": "cast(dest + 20 as double)",
    }
    return (
        _read(spark, sf_dir, "nation")
        .selectExpr("n_nationkey", "explode(sequence(0, 4)) AS dest")
        .selectExpr("n_nationkey", "dest", "explode(array('DTD', 'DTP')) AS svc_cd")
        .selectExpr("n_nationkey", "dest", "svc_cd", f"inline(array({bands}))")
        .selectExpr(*[f"{made.get(c, c)} AS {c}" for c in FREIGHT_RATES.names])
    )


def wh_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage cost per unit of every plant."""
    made = {
        "wh": _code("PLANT", "n_nationkey"),
        "cost_unit": "0.4D + 0.05D * n_nationkey",
        "year": "2013",
        "month": "5",
    }
    nations = _read(spark, sf_dir, "nation")
    return nations.selectExpr(*[f"{made[c]} AS {c}" for c in WH_COSTS.names])


def wh_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {
        "plant_id": _code("PLANT", "n_nationkey"),
        "daily_capacity": "cast(200 + 50 * n_nationkey as double)",
        "region": "'ALL'",
        "type": "'MAIN'",
        "status": "'ACTIVE'",
    }
    nations = _read(spark, sf_dir, "nation")
    return nations.selectExpr(*[f"{made[c]} AS {c}" for c in WH_CAPACITIES.names])


def supply_tables(spark: SparkSession, sf_dir: str, order_columns: list[str] | None = None) -> SupplyTables:
    return SupplyTables(
        order_list=order_list(spark, sf_dir, order_columns),
        freight_rates=freight_rates(spark, sf_dir),
        wh_costs=wh_costs(spark, sf_dir),
        wh_capacities=wh_capacities(spark, sf_dir),
    )
