"""The missing-value, text and rounding rules, each on its own."""

import pytest
from pyspark.sql import functions as F

from lanecost.functions import missing, text
from lanecost.operators.totals import rescale, top_n, with_totals


def value(spark, column, schema="x double", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def aggregate(spark, column, values):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(column.alias("v")).first()["v"]


def test_strict_sum_is_null_with_a_null_and_zero_over_nothing(spark):
    assert aggregate(spark, missing.strict_sum("x"), [1.0, 2.0]) == 3.0
    assert aggregate(spark, missing.strict_sum("x"), [1.0, None]) is None
    assert aggregate(spark, missing.strict_sum("x"), []) == 0.0


def test_strict_mean_and_median(spark):
    assert aggregate(spark, missing.strict_mean("x"), [1.0, 2.0]) == 1.5
    assert aggregate(spark, missing.strict_mean("x"), [1.0, None]) is None
    assert aggregate(spark, missing.strict(F.median, "x"), [1.0, 2.0, 4.0, 9.0]) == 3.0
    assert aggregate(spark, missing.strict(F.median, "x"), [1.0, None]) is None


def test_lenient_sum(spark):
    assert aggregate(spark, missing.lenient_sum("x"), [1.0, None]) == 1.0
    assert aggregate(spark, missing.lenient_sum("x"), [None]) == 0.0
    assert aggregate(spark, missing.lenient_sum("x"), []) == 0.0


def test_both_greatest(spark):
    assert value(spark, missing.both_greatest(F.lit(1.0), F.lit(2.0))) == 2.0
    assert value(spark, missing.both_greatest("x", F.lit(2.0))) is None


def test_division_by_zero_is_null(spark):
    assert value(spark, missing.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, missing.ratio(F.lit(0.0), F.lit(0.0))) is None


def test_choose_keeps_an_unknown_condition_unknown(spark):
    assert value(spark, missing.choose(F.col("x") > 1, F.lit("a"), F.lit("b"))) is None
    assert value(spark, missing.choose(F.col("x") > 1, F.lit("a"), F.lit("b")), row=(2.0,)) == "a"
    assert value(spark, missing.choose(F.col("x") > 1, F.lit("a"), F.lit("b")), row=(1.0,)) == "b"


@pytest.mark.parametrize("number, shown", [(0.0, "0"), (250.0, "250"), (99.99, "99.99"), (0.01, "0.01")])
def test_number_text(spark, number, shown):
    assert value(spark, text.number_text(F.lit(number))) == shown


def test_band_text(spark):
    assert value(spark, text.band_text(F.lit(100.0), F.lit(249.99))) == "100 - 249.99 kg"
    assert value(spark, text.band_text("x", "x")) == "NA - NA kg"
    assert value(spark, text.band_label(F.lit("  0 - 99.99 kg "))) == "0 - 99.99"


def test_only_the_first_occurrence_is_replaced(spark):
    assert value(spark, text.replace_first(F.lit("a_b_c"), "_", " ")) == "a b_c"
    assert value(spark, text.port_to_plant(F.lit("PORT09"))) == "PLANT09"
    assert value(spark, text.port_to_plant(F.lit("PORTPORT"))) == "PLANTPORT"
    assert value(spark, text.share_text(F.lit(0.75))) == "75.0%"


def test_titles(spark):
    assert value(spark, text.title(F.lit("transport_cost"))) == "Transport Cost"
    assert value(spark, text.title(F.lit("kg_cost"))) == "Kg Cost"


@pytest.mark.parametrize(
    "number, shown",
    [(12000.0, "$12,000"), (59.5, "$59.50"), (123456.7, "$123,457"), (-5.0, "-$5"), (0.975, "$0.98")],
)
def test_dollars(spark, number, shown):
    assert value(spark, text.dollar_text_auto(F.lit(number))) == shown


def test_dollars_round_half_to_even_whatever_the_noise(spark):
    assert value(spark, text.dollar_text(F.lit(16054.500000000002), 0)) == "$16,054"
    assert value(spark, text.dollar_text(F.lit(16055.499999999998), 0)) == "$16,056"


@pytest.mark.parametrize("number, shown", [(33.333, "33.3%"), (50.0, "50%"), (0.25, "0.2%"), (94.2, "94.2%")])
def test_percent_text(spark, number, shown):
    assert value(spark, text.percent_text(F.lit(number))) == shown


def rescaled(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    df = with_totals(df, low=F.min("x"), high=F.max("x"))
    scored = df.select("i", rescale("x", F.col("totals.low"), F.col("totals.high")).alias("s"))
    return [r["s"] for r in scored.orderBy("i").collect()]


def test_rescale(spark):
    assert rescaled(spark, [0.0, 5.0, 10.0]) == [0.0, 0.5, 1.0]
    assert rescaled(spark, [3.0, 3.0]) == [0.5, 0.5]
    assert rescaled(spark, [3.0, None, 5.0]) == [0.0, None, 1.0]
    assert rescaled(spark, [7.0]) == [0.5]
    assert rescaled(spark, [1.1, 1.1 + 2.0**-52]) == [0.5, 0.5]
    assert rescaled(spark, [None, None]) == [None, None]


def top(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return sorted((r["x"] for r in top_n(df, "x", n).collect()), key=lambda v: (v is None, -(v or 0)))


def test_top_n_keeps_ties_and_puts_nulls_last(spark):
    assert top(spark, [5.0, 4.0, 4.0, 3.0], 2) == [5.0, 4.0, 4.0]
    assert top(spark, [5.0, None, 3.0, None], 2) == [5.0, 3.0]
    assert top(spark, [5.0, None, None], 2) == [5.0, None, None]
    assert top(spark, [5.0, None], 10) == [5.0, None]
    assert top(spark, [], 3) == []
