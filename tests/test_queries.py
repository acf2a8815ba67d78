"""Every registered query against its SQL statement, and the shape of their plans."""

import re

import pytest
from compare import difference, duck, duck_table, spark_table

import __spark_entry__ as entry
from lanecost import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_statement():
    assert set(catalog.queries()) == set(oracle.statements())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_its_statement(spark, con, name):
    got = spark_table(entry.queries()[name](spark, SF))
    assert difference(got, duck_table(con, entry.oracle_sql()[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def windows_over_orders(text: str) -> list[str]:
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", text)
    return [s for s in specs if not s.startswith("rate_carrier") or "order_id" in s]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_no_query_uses_a_cross_join_or_a_window_over_everything(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*?windowspecdefinition\((.*?), ", text):
        assert not re.search(r" (ASC|DESC) NULLS", window), window
    assert "Python" not in text


def test_orders_are_not_shuffled_to_find_their_rate(spark):
    text = plan(entry.queries()["best_rates"](spark, SF))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^,]*)", text)
    assert not [s for s in shuffles if s.startswith("order_id")]
    # windows sweep the rate card by lane and range, none of them sees an order
    assert not windows_over_orders(text)


def test_shares_reuse_the_shuffle_of_their_mart(spark):
    df = entry.queries()["shipping_shares"](spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_scans_read_only_the_needed_columns(spark):
    text = plan(entry.queries()["warehouse_capacity"](spark, SF))
    assert "customer.parquet" not in text and "part.parquet" not in text
    scan = re.search(r"FileScan parquet \[l_orderkey[^\]]*\]", text).group(0)
    assert "l_quantity" not in scan and "l_partkey" not in scan


def test_a_filter_stays_above_the_checks_of_the_mart(spark):
    text = plan(entry.queries()["shipping_of_plant"](spark, SF))
    below = text[text.index("HashAggregate(keys=[origin_port") :]
    assert "PORT03" in text and "PORT03" not in below


def test_repeated_ids_read_the_orders_twice_at_most(spark):
    text = plan(entry.queries()["shipping_costs_repeated_ids"](spark, SF))
    assert text.count("lineitem.parquet") <= 2


def test_seeded_rows_break_every_rule(spark):
    for name in ("check_order_list_seeded", "check_freight_rates_seeded", "check_service_levels_seeded"):
        found = entry.queries()[name](spark, "/root/testdata/sf0.01").collect()
        assert all(r["n_bad"] > 0 for r in found), name


def test_repeated_ids_need_no_window(spark):
    assert not windows_over_orders(plan(entry.queries()["best_rates_repeated_ids"](spark, SF)))


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith(("overview_kpis", "cost_kpis"))])
def test_key_figures_read_the_orders_twice_at_most(spark, name):
    assert plan(entry.queries()[name](spark, SF)).count("lineitem.parquet") <= 2
