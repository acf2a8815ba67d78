"""Rate choice against a brute-force version in plain Python, on all of its paths."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException

from lanecost.operators import rating
from lanecost.plans import marts, service, shipping
from lanecost.sources.schemas import FREIGHT_RATES

ORDER = (
    "order_id long, carrier string, origin_port string, destination_port string, "
    "service_level string, weight double"
)
BANDS = [(0.0, 99.99), (100.0, 249.99), (100.0, 299.99), (250.0, 499.99), (0.0, 5000.0)]


def made_orders(n=400, ids=None, seed=1):
    rnd = random.Random(seed)
    return [
        (
            i if ids is None else rnd.randrange(ids),
            rnd.choice(["A", "B", None]),
            rnd.choice(["PORT01", "PORT02"]),
            "PORT09",
            rnd.choice(["DTD", "DTP", "CRF"]),
            rnd.choice([None, 0.0, 99.99, 99.995, 100.0, round(rnd.uniform(0, 600), 2)]),
        )
        for i in range(n)
    ]


def made_rates(seed=2):
    rnd = random.Random(seed)
    rows = [
        (o, "PORT09", c, s, m, low, high, round(rnd.uniform(0.1, 3), 2), float(rnd.randrange(50)))
        for o in ("PORT01", "PORT02")
        for c in ("A", "B", None)
        for s in ("DTD", "DTP")
        for m in ("AIR", "GROUND")
        for low, high in rnd.sample(BANDS, 3)
    ]
    return rows + rows[:5]


def brute_force(orders, rates):
    """Winning (order id, mode, low, high, rate) rows with their count."""
    by_id = defaultdict(list)
    for oid, carrier, origin, dest, level, weight in orders:
        for o, d, c, s, mode, low, high, rate, least in set(rates):
            if (carrier, origin, dest, level) == (c, o, d, s) and weight is not None and low <= weight <= high:
                by_id[oid].append((abs(weight - low), (oid, mode, low, high, rate, max(least, weight * rate))))
    won = Counter()
    for found in by_id.values():
        least = min(gap for gap, _ in found)
        won.update(row for gap, row in found if gap == least)
    return won


def result(df):
    columns = ("order_id", "mode_dsc", "minm_wgh_qty", "max_wgh_qty", "rate", "shipping_cost")
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame(made_rates(), FREIGHT_RATES)


@pytest.fixture(params=["broadcast", "shuffle"])
def path(request, spark):
    """Both ways to join the rate card, whatever its size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1" if request.param == "shuffle" else "1g")
    yield request.param
    for name in names:
        spark.conf.unset(name)


def test_unique_ids(spark, rates, path):
    rows = made_orders()
    orders = spark.createDataFrame(rows, ORDER)
    want = brute_force(rows, made_rates())
    assert result(rating.rate_orders(orders, rates, unique_ids=True)) == want
    assert result(rating.rate_orders(orders, rates)) == want


def test_repeated_ids(spark, rates, path):
    rows = made_orders(ids=40)
    want = brute_force(rows, made_rates())
    assert result(rating.rate_orders(spark.createDataFrame(rows, ORDER), rates)) == want


def test_one_id_holding_a_third_of_all_rows(spark, rates):
    rows = made_orders(300) + [(7, "A", "PORT01", "PORT09", "DTD", 120.0)] * 150
    orders = spark.createDataFrame(rows, ORDER).repartition(6)
    found = rating.in_band(orders, rates)
    want = brute_force(rows, made_rates())
    kept = rating.smallest_gap_per_order(found)
    kept = kept.withColumn("shipping_cost", rating.freight_cost())
    assert result(kept) == want


def test_first_of_the_ties(spark, rates, path):
    rows = made_orders(ids=60)
    got = result(rating.rate_orders(spark.createDataFrame(rows, ORDER), rates, ties="first"))
    want = brute_force(rows, made_rates())
    assert set(got) <= set(want)
    assert Counter(key[0] for key in got.elements()) == Counter({key[0]: 1 for key in want})


def test_first_of_the_ties_with_unique_ids(spark, rates):
    orders = spark.createDataFrame(made_orders(), ORDER)
    fast = result(rating.rate_orders(orders, rates, ties="first", unique_ids=True))
    assert fast == result(rating.rate_orders(orders, rates, ties="first"))


def test_unrated_orders(spark, rates, path):
    rows = made_orders()
    got = {r["order_id"] for r in rating.unrated_orders(spark.createDataFrame(rows, ORDER), rates).collect()}
    assert got == {r[0] for r in rows} - {key[0] for key in brute_force(rows, made_rates())}


def test_candidates_keep_every_order(spark, rates, path):
    rows = made_orders(100)
    lanes = Counter((r[2], r[0], r[1], r[3]) for r in set(made_rates()))
    want = sum(max(1, lanes[(c, o, d, s)]) for _, c, o, d, s, _ in rows)
    assert rating.candidates(spark.createDataFrame(rows, ORDER), rates).count() == want


def test_mart_is_the_same_on_both_paths(spark, rates, path):
    orders = spark.createDataFrame([r for r in made_orders() if r[5]], ORDER)
    mart = marts.shipping_costs(orders, rates)
    total = sum(k[5] * n for k, n in brute_force([r for r in made_orders() if r[5]], made_rates()).items())
    rows = mart.collect()
    assert round(sum(r["total_shipping_cost"] for r in rows), 6) == round(total, 6)
    assert all(r["weight_band_ord"] for r in rows)


def test_service_mix_equals_the_joined_rows(spark, rates, path):
    orders = spark.createDataFrame(made_orders(), ORDER)
    mix = shipping.weight_band_service_mix(orders, rates).collect()
    rows = rating.candidates(orders, rates).collect()
    assert sum(r["total_orders"] for r in mix) == len(rows)
    assert {r["weight_band"] for r in mix if r["service_level"] == "CRF"} == {"NA - NA"}
    assert all(r["total_cost"] is None for r in mix if r["weight_band"] == "NA - NA")


def test_first_rate_costs(spark, rates, path):
    orders = spark.createDataFrame(made_orders(), ORDER)
    costed = service.cost_by_first_rate(orders, rates, unique_ids=True)
    assert costed.count() == orders.count()
    again = service.cost_by_first_rate(orders, rates)
    key = lambda r: r["order_id"]
    assert sorted(costed.collect(), key=key) == sorted(again.collect(), key=key)
    for r in costed.collect():
        if r["service_level"] == "CRF":
            assert r["shipping_cost"] is None


def test_unknown_band_stops_the_job(spark, rates):
    odd = spark.createDataFrame(
        [("PORT01", "PORT09", "A", "DTD", "AIR", 0.0, 123.0, 1.0, 1.0)], FREIGHT_RATES
    )
    orders = spark.createDataFrame([(1, "A", "PORT01", "PORT09", "DTD", 5.0)], ORDER)
    with pytest.raises(PySparkException, match="outside the known ones: 0 - 123"):
        marts.shipping_costs(orders, odd).collect()


def test_zero_weight_stops_the_job(spark, rates):
    orders = spark.createDataFrame([(1, "A", "PORT01", "PORT09", "DTD", 0.0)], ORDER)
    card = spark.createDataFrame(
        [("PORT01", "PORT09", "A", "DTD", "AIR", 0.0, 99.99, 1.0, 1.0)], FREIGHT_RATES
    )
    with pytest.raises(PySparkException, match="zero or negative weight"):
        marts.shipping_costs(orders, card).collect()


def test_a_filter_does_not_switch_the_checks_off(spark):
    card = [(p, "PORT09", "A", "DTD", "AIR", 0.0, 99.99, 1.0, 1.0) for p in ("PORT01", "PORT02")]
    rows = [(1, "A", "PORT01", "PORT09", "DTD", 5.0), (2, "A", "PORT02", "PORT09", "DTD", 0.0)]
    mart = marts.shipping_costs(spark.createDataFrame(rows, ORDER), spark.createDataFrame(card, FREIGHT_RATES))
    with pytest.raises(PySparkException, match="zero or negative weight"):
        mart.where("origin_port = 'PORT01'").collect()


def test_both_ways_to_a_first_row_agree(spark):
    card = [("PORT01", "PORT09", "A", "DTD", "AIR", 0.0, 9.0, 1.0, 5.0), ("PORT02", "PORT09", "A", "DTP", "AIR", 2.0, 9.0, 1.0, 500.0)]
    rows = [(1, "A", "PORT02", "PORT09", "DTP", 1.0), (1, "A", "PORT01", "PORT09", "DTD", 3.0)]
    orders, rates = spark.createDataFrame(rows, ORDER), spark.createDataFrame(card, FREIGHT_RATES)
    direct = service.service_lanes(service.cost_by_first_rate(orders, rates))
    through = service.analyze_service_levels(service.service_costing(orders, rates))
    assert service.service_summary(direct).collect() == through["service_summary"].collect()


def test_missing_minimum_cost_makes_the_total_missing(spark):
    card = spark.createDataFrame(
        [("PORT01", "PORT09", "A", "DTD", "AIR", 0.0, 99.99, 1.0, None)], FREIGHT_RATES
    )
    orders = spark.createDataFrame([(1, "A", "PORT01", "PORT09", "DTD", 5.0)], ORDER)
    row = marts.shipping_costs(orders, card).first()
    assert row["total_shipping_cost"] is None and row["n_orders"] == 1


def test_missing_columns_are_named(spark, rates):
    with pytest.raises(Exception, match="weight"):
        marts.shipping_costs(spark.range(1), rates)


def test_ids_stated_as_unique_decide_alone_on_both_paths(spark, path):
    card = spark.createDataFrame([("PORT01", "PORT09", "A", "DTD", "AIR", 0.0, 99.99, 1.0, 1.0)], FREIGHT_RATES)
    orders = spark.createDataFrame([(1, "A", "PORT01", "PORT09", "DTD", w) for w in (5.0, 7.0)], ORDER)
    for ties in ("all", "first"):
        assert rating.rate_orders(orders, card, ties=ties, unique_ids=True).count() == 2
        assert rating.rate_orders(orders, card, ties=ties).count() == 1


def test_tied_and_nested_bands_do_not_multiply(spark):
    lane = ("PORT01", "PORT09", "A", "DTD")
    tied = [(*lane, f"M{i}", 0.0, 10_000.0 + i, 1.0, 1.0) for i in range(450)]
    nested = [(*lane, "AIR", 10.0 * i + 1, 10.0 * i + 5, 1.0, 1.0) for i in range(450)]
    card = spark.createDataFrame(tied + nested, FREIGHT_RATES)
    assert rating.winning_bounds(card).count() < 2_000
    assert rating.rates_by_bound(card, "all").count() == 900
    assert rating.rates_by_bound(card, "first").count() == 900


@pytest.mark.parametrize("seed", range(4))
def test_any_mix_of_overlapping_touching_and_empty_bands(spark, seed):
    rnd = random.Random(seed)
    card = []
    for lane in ("PORT01", "PORT02"):
        for _ in range(12):
            low = float(rnd.randrange(12))
            high = rnd.choice([None, low - 1, low, low + rnd.randrange(1, 9)])
            rate = (lane, "PORT09", "A", "DTD", rnd.choice(["AIR", "GROUND"]), low, high, 1.0 + rnd.randrange(3), 0.0)
            card.append(rate)
    weights = [w / 4 for w in range(-4, 90)]
    rows = [(i, "A", rnd.choice(["PORT01", "PORT02"]), "PORT09", "DTD", w) for i, w in enumerate(weights)]
    orders = spark.createDataFrame(rows, ORDER)
    rates = spark.createDataFrame(card, FREIGHT_RATES)
    want = brute_force(rows, [r for r in card if r[6] is not None])
    assert result(rating.rate_orders(orders, rates, unique_ids=True)) == want
    first = result(rating.rate_orders(orders, rates, ties="first", unique_ids=True))
    assert set(first) <= set(want)
    assert {k[0] for k in first} == {k[0] for k in want} and len(first) == sum(first.values())
    assert len(first) == len({k[0] for k in first})


@pytest.mark.parametrize("seed", range(6))
def test_a_lane_cut_into_ranges_gives_the_same_rates(spark, monkeypatch, seed):
    """Bands that nest, touch, cross whole ranges or have no end, with ranges of a few bounds."""
    monkeypatch.setattr(rating, "RANGE_BOUNDS", 3)
    rnd = random.Random(seed)
    card = []
    for lane in ("PORT01", "PORT02", None):
        for _ in range(rnd.choice([1, 4, 40])):
            low = rnd.choice([float(rnd.randrange(60)), rnd.uniform(0, 60)])
            high = rnd.choice([low, low + rnd.randrange(1, 6), low + rnd.randrange(1, 60), float("inf")])
            card.append((lane, "PORT09", "A", "DTD", rnd.choice(["AIR", "GROUND"]), low, high, 1.0, 0.0))
    weights = sorted({w / 2 for w in range(-2, 140)} | {r[5] for r in card} | {r[6] for r in card})
    weights = [None, *[w for w in weights if w < float("inf")]]
    rows = [(i, "A", lane, "PORT09", "DTD", w) for i, (lane, w) in enumerate((x, w) for x in ("PORT01", "PORT02", None) for w in weights)]
    orders = spark.createDataFrame(rows, ORDER)
    rates = spark.createDataFrame(card, FREIGHT_RATES)
    want = brute_force(rows, card)
    assert result(rating.rate_orders(orders, rates, unique_ids=True)) == want
    all_fitting = Counter(
        (r[0], c[5], c[6]) for r in rows for c in set(card) if r[2] == c[0] and r[5] is not None and c[5] <= r[5] <= c[6]
    )
    got = rating.in_band(orders, rates).select("order_id", "minm_wgh_qty", "max_wgh_qty")
    assert Counter(map(tuple, got.collect())) == all_fitting
    unrated = {r["order_id"] for r in rating.unrated_orders(orders, rates).collect()}
    assert unrated == {r[0] for r in rows} - {k[0] for k in want}


def test_a_lane_of_very_many_bounds(spark):
    """20,000 lower bounds in one lane, many nested: the winner at each probed weight, and few segments."""
    n = 20_000
    lane = ("PORT01", "PORT09", "A", "DTD")
    rnd = random.Random(9)
    spans = [(float(i), float(i) + rnd.choice([0.25, 0.5, 3.0, 700.0, 9000.0])) for i in range(n)]
    card = spark.createDataFrame([(*lane, "AIR", low, high, 1.0, 1.0) for low, high in spans], FREIGHT_RATES)
    segments = rating.winning_bounds(card)
    assert segments.count() < 2 * n
    weights = [rnd.uniform(-5, n + 100) for _ in range(300)] + [float(rnd.randrange(n)) for _ in range(100)]
    orders = spark.createDataFrame([(i, "A", "PORT01", "PORT09", "DTD", w) for i, w in enumerate(weights)], ORDER)
    got = {r["order_id"]: r["minm_wgh_qty"] for r in rating.rate_orders(orders, card, unique_ids=True).collect()}
    want = {i: max((low for low, high in spans if low <= w <= high), default=None) for i, w in enumerate(weights)}
    assert got == {i: low for i, low in want.items() if low is not None}


def test_no_row_and_no_window_holds_a_long_lane(spark):
    card = [("PORT01", "PORT09", "A", "DTD", "AIR", float(i), i + 2.5, 1.0, 1.0) for i in range(3000)]
    segments = rating.winning_bounds(spark.createDataFrame(card, FREIGHT_RATES))
    sizes = [r["count"] for r in segments.groupBy("range").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 200
    text = segments._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "collect_set" not in text
