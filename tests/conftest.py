from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


SHIPPING = (
    "origin_port string, destination_port string, carrier string, total_shipping_cost double, "
    "total_weight double, n_orders double, mode_dsc string"
)
COSTS = (
    "plant_code string, storage_cost double, cost_per_unit double, cost_per_kg double, "
    "total_units double, total_orders double"
)
ORDERS = "plant_code string, carrier string, service_level string"


class Tables:
    def __init__(self, spark, shipping, costs, orders, capacity=()):
        self.shipping = spark.createDataFrame(shipping, SHIPPING)
        self.costs = spark.createDataFrame(costs, COSTS)
        self.orders = spark.createDataFrame(orders, ORDERS)
        self.capacity = spark.createDataFrame(
            list(capacity), "plant_code string, capacity_utilization double"
        )


@pytest.fixture(scope="session")
def calculation(spark):
    return Tables(
        spark,
        [
            ("PLANT01", "DEST01", "CARRIER1", 1000.0, 100.0, 10.0, "AIR"),
            ("PLANT01", "DEST02", "CARRIER1", 2000.0, 200.0, 20.0, "GROUND"),
            ("PLANT02", "DEST01", "CARRIER2", 3000.0, 300.0, 30.0, "AIR"),
        ],
        [
            ("PLANT01", 5000.0, 50.0, 5.0, 100.0, 50.0),
            ("PLANT02", 7000.0, 70.0, 7.0, 100.0, 50.0),
        ],
        [("PLANT01", "CARRIER1", "CRF"), ("PLANT02", "CARRIER2", "DTD")],
    )


@pytest.fixture(scope="session")
def filtering(spark):
    return Tables(
        spark,
        [
            ("PLANT01", "DEST01", "CARRIER1", 100.0, 50.0, 5.0, "AIR"),
            ("PLANT02", "DEST02", "CARRIER1", 200.0, 75.0, 8.0, "GROUND"),
            ("PLANT01", "DEST03", "CARRIER2", 300.0, 100.0, 10.0, "AIR"),
        ],
        [
            ("PLANT01", 150.0, 1.5, 0.5, 100.0, 10.0),
            ("PLANT02", 250.0, 2.5, 1.0, 200.0, 20.0),
        ],
        [("PLANT01", "CARRIER1", "CRF"), ("PLANT02", "CARRIER1", "DTD")],
        [("PLANT01", 0.75), ("PLANT02", 0.85)],
    )


@pytest.fixture(scope="session")
def edge(spark):
    return Tables(
        spark,
        [
            ("PLANT01", "DEST01", "CARRIER1", 1000.0, 100.0, 10.0, "AIR"),
            ("PLANT02", "DEST02", "CARRIER2", None, 0.0, 0.0, "GROUND"),
            ("PLANT03", "DEST03", "CARRIER1", 0.0, None, 5.0, "AIR"),
            ("PLANT04", "DEST04", "CARRIER2", -100.0, 50.0, None, "GROUND"),
        ],
        [
            ("PLANT01", 5000.0, 50.0, 5.0, 100.0, 50.0),
            ("PLANT02", None, 0.0, None, 0.0, None),
            ("PLANT03", 0.0, None, 0.0, None, 0.0),
            ("PLANT04", -1000.0, -10.0, -1.0, 50.0, 25.0),
        ],
        [
            ("PLANT01", "CARRIER1", "CRF"),
            ("PLANT02", "CARRIER2", "DTD"),
            ("PLANT03", "CARRIER1", "CRF"),
            ("PLANT04", "CARRIER2", "DTD"),
        ],
    )
