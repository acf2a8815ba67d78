"""Orders and rate card stored by lane: the joins, the period, the results."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest

from lanecost.operators import rating
from lanecost.sources import layout
from lanecost.sources.schemas import FREIGHT_RATES

FIRST = date(2024, 2, 27)
ORDER = (
    "order_id long, carrier string, origin_port string, destination_port string, service_level string, "
    "weight double, order_date date"
)
COLUMNS = ["order_id", "mode_dsc", "minm_wgh_qty", "max_wgh_qty", "rate", "weight_band", "gap", "shipping_cost"]


@pytest.fixture(scope="module")
def stored(spark):
    """Two tables in a database of their own, joined as large ones are."""
    pick = random.Random(12)
    lanes = [(f"PORT0{i}", pick.choice(["PORT09", None]), pick.choice("AB"), pick.choice(["DTD", None])) for i in range(6)]
    card = []
    for origin, dest, carrier, level in lanes:
        for _ in range(pick.choice([3, 150])):
            low = float(pick.randrange(100))
            card.append((origin, dest, carrier, level, pick.choice(["AIR", "GROUND"]), low, low + pick.randrange(60), 1.0, 2.0))
    rows = []
    for i in range(1500):
        origin, dest, carrier, level = pick.choice([*lanes, ("PORT07", "PORT09", "A", "DTD")])
        weight = pick.choice([None, float(pick.randrange(170)), pick.uniform(0, 170)])
        rows.append((i, carrier, origin, dest, level, weight, FIRST + timedelta(days=i % 4)))
    orders, rates = spark.createDataFrame(rows, ORDER), spark.createDataFrame(card, FREIGHT_RATES)
    settings = layout.session_settings() | {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    spark.sql("CREATE DATABASE IF NOT EXISTS lanecost_layout")
    layout.write_orders(orders, "lanecost_layout.orders", 4)
    layout.write_card(rates, "lanecost_layout.card", 4)
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield orders, rates
    for name in settings:
        spark.conf.unset(name)
    spark.sql("DROP DATABASE lanecost_layout CASCADE")


def rated(spark, *period):
    return layout.rated_orders(spark, "lanecost_layout.orders", "lanecost_layout.card", *period)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_join_without_a_shuffle(spark, stored):
    text = plan(rated(spark))
    assert text.count("SortMergeJoin") == 3
    assert "Exchange" not in text


def test_a_period_reads_its_days_only(spark, stored):
    orders, rates = stored
    day = FIRST + timedelta(days=2)
    df = rated(spark, day, day)
    assert "PartitionFilters: [isnotnull(order_date" in plan(df)
    assert [r[0] for r in df.select("order_date").distinct().collect()] == [day]
    files = {f for f in df.inputFiles() if "order_date=" in f}
    assert files and all(f"order_date={day}" in f for f in files)


def test_stored_tables_give_the_same_rates(spark, stored):
    orders, rates = stored
    want = Counter(map(tuple, rating.rate_orders(orders, rates, unique_ids=True).select(COLUMNS).collect()))
    got = Counter(map(tuple, rated(spark).select(COLUMNS).collect()))
    assert got == want and len(got) > 500


def test_lanes_do_not_share_a_text(spark):
    rows = [("a", "b"), ("a+1:b", None), (None, "a"), ("a", None), ("", ""), (None, None), ("", None), ("a:", "b")]
    texts = spark.createDataFrame(rows, "x string, y string").select(layout.lane_text(["x", "y"])).collect()
    assert len({r[0] for r in texts}) == len(rows)
