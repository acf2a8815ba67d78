"""Choose the freight rate of each order.

A rate applies when lane, carrier and service level agree and the weight lies in its band (both ends
count). The best rate has the smallest distance between the weight and the band's lower bound; ties
are kept unless asked otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import both_greatest
from ..functions.text import band_label, band_text
from .lookup import lookup

LANE = [
    ("carrier", "rate_carrier"),
    ("origin_port", "orig_port_cd"),
    ("destination_port", "dest_port_cd"),
    ("service_level", "svc_cd"),
]
RATE_ORDER = ("minm_wgh_qty", "max_wgh_qty", "mode_dsc", "rate", "minimum_cost")

RANGE_BOUNDS = 64  # rates of a lane beyond which its weights are cut into ranges
MOST_RANGES = 128


def clean_rates(rates: DataFrame) -> DataFrame:
    """The rate card without exact duplicates."""
    return rates.distinct()


def _rate_side(rates: DataFrame) -> DataFrame:
    return rates.withColumnRenamed("carrier", "rate_carrier")


def _lane_keys() -> list[str]:
    return [right for _, right in LANE]


def _bands(rates: DataFrame) -> DataFrame:
    """The bounds of the rates whose band holds any weight."""
    held = _rate_side(rates).where("max_wgh_qty >= minm_wgh_qty")
    return held.select(*_lane_keys(), F.col("minm_wgh_qty").alias("low"), F.col("max_wgh_qty").alias("high"))


def lane_ranges(rates: DataFrame) -> DataFrame:
    """The weights at which the ranges of each lane begin, in `edges`; the first range has no lower end.

    A lane of RANGE_BOUNDS rates or fewer is one range. A longer one is cut at quantiles of its lower bounds, which
    are a mergeable sketch, so no task sees a whole lane. More than MOST_RANGES are not made; ranges grow instead.
    """
    steps = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    lanes = _bands(rates).groupBy(*_lane_keys())
    lanes = lanes.agg(F.count(F.lit(1)).alias("bounds"), F.percentile_approx("low", steps).alias("quantiles"))
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(F.col("bounds") / RANGE_BOUNDS).cast("int"))
    places = F.transform(F.sequence(F.lit(2), ranges), lambda k: F.floor((k - 1) * MOST_RANGES / ranges).cast("int"))
    cuts = F.array_distinct(F.transform(places, lambda k: F.element_at("quantiles", k)))
    whole = F.array(F.lit(float("-inf")))
    return lanes.select(*_lane_keys(), F.when(ranges > 1, F.concat(whole, cuts)).otherwise(whole).alias("edges"))


def range_of(edges: Column, weight: Column) -> Column:
    """The number of the range, from 1, that holds a weight; 0 for none."""
    return F.size(F.filter(edges, lambda edge: edge <= weight))


# The ranges from that of the band's lower bound to that of its upper bound.
_REACHED = """inline(transform(
    sequence(size(filter(edges, e -> e <= low)), size(filter(edges, e -> e <= high))),
    (k, i) -> struct(k AS range, edges[k - 1] AS floor, get(edges, k) AS ceiling,
      i = 0 OR get(edges, k) IS NULL OR get(edges, k) > high AS at_end)))"""


def _spread(bands: DataFrame, lanes: DataFrame) -> DataFrame:
    """The bands in each range that they reach into: `range`, its ends, and whether it is the band's first or last."""
    placed = lookup(bands, lanes, [(k, k) for k in _lane_keys()])
    return placed.selectExpr(*bands.columns, _REACHED)


# A row of each range for each of its bands, to rows of three kinds. `node` rows say which dyadic stretches of gaps the
# band covers whole, `gap` rows ask for all stretches around the gap after the band's lower bound, and `end` rows say in
# which gap the band ends. Gaps are numbered from 1 by the lower bound before them.
_STRETCHES = """
    transform(sequence(0, levels), k -> struct(
      int(k) AS level, shiftright(place + shiftleft(1L, k) - 1, k) AS first, shiftright(until, k) AS stop))
"""
_ROWS = f"""
    concat(
      flatten(transform(filter({_STRETCHES}, s -> s.first < s.stop), s -> filter(array(
        if(s.first % 2 = 1, struct(s.level AS level, s.first AS node, low AS cover,
          cast(null AS bigint) AS gap, cast(null AS double) AS own, cast(null AS double) AS stop), null),
        if(s.stop % 2 = 1, struct(s.level AS level, s.stop - 1 AS node, low AS cover,
          cast(null AS bigint) AS gap, cast(null AS double) AS own, cast(null AS double) AS stop), null)
        ), x -> x IS NOT NULL))),
      transform(sequence(0, levels), k -> struct(int(k) AS level, shiftright(place, k) AS node,
        cast(null AS double) AS cover, place AS gap, cast(null AS double) AS own, next AS stop)),
      array(struct(-1 AS level, place AS node, cast(null AS double) AS cover, until AS gap, low AS own, high AS stop)))
"""


# One statement, as a frame for each step would be analysed as often. All of it keeps the partitions by lane and range.
_OWN = "rate_carrier, orig_port_cd, dest_port_cd, svc_cd, range"
_SWEEP = f"""
WITH dealt AS (SELECT /*+ REPARTITION({_OWN}) */ * FROM {{spread}}),
bands AS (
  SELECT {_OWN}, floor, ceiling, max(low) AS low, max(if(at_end, high, double('inf'))) AS high
  FROM dealt GROUP BY {_OWN}, floor, ceiling, if(at_end, low, null)
),
bounds AS (
  SELECT {_OWN}, floor, ceiling, low, high, inline(array(struct(low AS at, 0 AS kind), struct(high AS at, 1 AS kind)))
  FROM bands
),
counted AS (
  SELECT *, sum(1 - kind) OVER (PARTITION BY {_OWN} ORDER BY at, kind ROWS UNBOUNDED PRECEDING) AS lows FROM bounds
),
-- place: which lower bound a band has; until: the lower bounds up to its upper bound, and one more beyond the range
ordered AS (
  SELECT {_OWN}, floor, ceiling, low, high, min(lows) AS place,
    max(lows) + if(high >= ceiling, 1L, 0L) AS until
  FROM counted GROUP BY {_OWN}, floor, ceiling, low, high
),
placed AS (
  SELECT *, coalesce(lead(low) OVER (PARTITION BY {_OWN} ORDER BY low), ceiling) AS next,
    int(floor(log2(count(*) OVER (PARTITION BY {_OWN}) + 1))) AS levels
  FROM ordered
),
stretches AS (SELECT {_OWN}, floor, ceiling, inline({_ROWS}) FROM placed),
covered AS (SELECT *, max(cover) OVER (PARTITION BY {_OWN}, level, node) AS widest FROM stretches),
found AS (
  SELECT {_OWN}, floor, ceiling, gap, stop, own IS NOT NULL AS stop_in, coalesce(own, max(widest)) AS low
  FROM covered WHERE gap IS NOT NULL AND stop IS NOT NULL AND (ceiling IS NULL OR own IS NULL OR stop < ceiling)
  GROUP BY {_OWN}, floor, ceiling, gap, own, stop
),
swept AS (
  SELECT *, max(stop) OVER (
    PARTITION BY {_OWN}, gap ORDER BY low DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM found WHERE low IS NOT NULL
),
segments AS (
  SELECT {_OWN}, low, greatest(coalesce(reach, low), floor) AS start,
    reach IS NULL OR coalesce(reach, low) < floor AS start_in, stop, stop_in
  FROM swept WHERE reach IS NULL OR stop > reach
)
SELECT * FROM segments WHERE stop > start OR (stop = start AND start_in AND stop_in)
"""


def winning_bounds(rates: DataFrame, lanes: DataFrame | None = None) -> DataFrame:
    """The lower bound that wins at each weight of a lane, as segments of weight, by `range` of `lanes`.

    The smallest distance to the lower bound is the largest lower bound whose bands hold the weight, so it depends
    on the rate card alone. Rates with one lower bound are one band here, as far as their largest upper bound. A segment
    says for each end whether the end itself belongs to it.

    Within a range, lower bounds cut the weights into gaps. In a gap win, from its lower bound on, the bands that end in
    it, the largest lower bound first, each from where the ones before it end; then the band of the largest lower bound
    that covers the rest of the gap whole. That one is the largest over the dyadic stretches of gaps around the gap. A
    lane of n bounds in one range has less than 2 * n segments; a band that reaches into further ranges is kept in its
    first and last, and of the bands that cross a range the one with the largest lower bound. No row holds a lane, and a
    task holds a range at most.
    """
    lanes = lane_ranges(rates) if lanes is None else lanes
    spread = _spread(_bands(rates), lanes)
    return spread.sparkSession.sql(_SWEEP, spread=spread)


def segment_holds_weight(orders: DataFrame, card: DataFrame) -> Column:
    weight = orders["weight"]
    after = (weight > card["start"]) | ((weight == card["start"]) & card["start_in"])
    before = (weight < card["stop"]) | ((weight == card["stop"]) & card["stop_in"])
    return after & before


def rates_by_bound(rates: DataFrame, ties: str) -> DataFrame:
    """Rates with `above`, the upper bound under which another rate takes their place.

    With ties="all" that is none. With "first" the rate with the least upper bound that holds the weight comes
    first, then the least mode, rate and minimum cost, so one rate is left for each pair of bounds.
    """
    card = _rate_side(clean_rates(rates)).where("max_wgh_qty >= minm_wgh_qty")
    if ties == "all":
        return card.withColumn("above", F.lit(None).cast("double"))
    bounds = [*_lane_keys(), "minm_wgh_qty", "max_wgh_qty"]
    first = card.groupBy(*bounds).agg(F.min(F.struct("mode_dsc", "rate", "minimum_cost")).alias("first"))
    same = W.partitionBy(*bounds[:-1]).orderBy("max_wgh_qty")
    return first.select(*bounds, "first.*", F.lag("max_wgh_qty").over(same).alias("above"))


def rate_holds_weight(orders: DataFrame, card: DataFrame) -> Column:
    """For rates of the lower bound that wins at a weight, as `rates_by_bound` has them."""
    weight = orders["weight"]
    return (weight <= card["max_wgh_qty"]) & (card["above"].isNull() | (weight > card["above"]))


def first_rates(rates: DataFrame, order: tuple[str, ...] = RATE_ORDER) -> DataFrame:
    """One row per lane with the first rate in the given column order, no band test."""
    entry = F.struct(*order, *[c for c in RATE_ORDER if c not in order])
    first = _rate_side(rates).groupBy(*_lane_keys()).agg(F.min(entry).alias("first"))
    return first.select(*_lane_keys(), "first.*")


def freight_cost() -> Column:
    """Weight times rate, but at least the minimum cost; null when either is missing."""
    return both_greatest(F.col("minimum_cost"), F.col("weight") * F.col("rate"))


def candidates(orders: DataFrame, rates: DataFrame, how: str = "left") -> DataFrame:
    """Every order with every rate of its lane, no band test."""
    card = _rate_side(clean_rates(rates))
    return lookup(orders, card, LANE, how=how)


def _band_holds_weight(orders: DataFrame, card: DataFrame) -> Column:
    return orders["weight"].between(card["minm_wgh_qty"], card["max_wgh_qty"])


def _ranged(orders: DataFrame, lanes: DataFrame, how: str = "inner") -> DataFrame:
    """Orders with the range of their lane that holds their weight; orders of unknown lanes drop out of an inner join."""
    found = lookup(orders, lanes, LANE, how=how)
    return found.withColumn("weight_range", range_of(F.col("edges"), F.col("weight"))).drop("edges")


RANGED_LANE = [*LANE, ("weight_range", "range")]


def in_band(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Every order with every rate whose band holds its weight.

    Weights and bands are cut into the ranges of their lane, which join by equality; the band itself is only tested
    within a range.
    """
    lanes = lane_ranges(rates)
    card = _rate_side(clean_rates(rates)).where("max_wgh_qty >= minm_wgh_qty")
    card = card.withColumns({"low": F.col("minm_wgh_qty"), "high": F.col("max_wgh_qty")})
    card = _spread(card, lanes).drop("low", "high", "floor", "ceiling", "at_end")
    card = card.withColumn("weight_band", band_label(band_text("minm_wgh_qty", "max_wgh_qty")))
    joined = lookup(_ranged(orders, lanes), card, RANGED_LANE, also=_band_holds_weight).drop("weight_range")
    return joined.withColumn("gap", F.abs(F.col("weight") - F.col("minm_wgh_qty")))


def rate_orders(
    orders: DataFrame,
    rates: DataFrame,
    *,
    ties: str = "all",
    unique_ids: bool = False,
) -> DataFrame:
    """Orders with their best rate, its band and the shipping cost; unrated orders drop out.

    Rates compete within an order id. With `unique_ids` the caller states that order_id is a key, so each row
    decides alone and the orders are not shuffled by their ids. Otherwise rows that share an id compete with each
    other, however many they are. The size of the rate card changes the way of its joins, never the result.
    """
    if ties not in ("all", "first"):
        raise ValueError("ties must be 'all' or 'first'")
    rated = _best_per_row(orders, rates, ties)
    if not unique_ids:
        rated = first_per_order(rated) if ties == "first" else smallest_gap_per_order(rated)
    return rated.withColumn("shipping_cost", freight_cost())


def _best_per_row(orders: DataFrame, rates: DataFrame, ties: str) -> DataFrame:
    """Best rates of each row: the range of its weight, the lower bound that wins there, the rates with this bound.

    All three tables are as long as the rate card at most, and tied rates meet only the orders that they win.
    """
    lanes = lane_ranges(rates)
    segments = winning_bounds(rates, lanes)
    bounded = lookup(_ranged(orders, lanes), segments, RANGED_LANE, also=segment_holds_weight)
    bounded = bounded.drop("start", "start_in", "stop", "stop_in", "weight_range")
    card = rates_by_bound(rates, ties)
    card = card.withColumn("weight_band", band_label(band_text("minm_wgh_qty", "max_wgh_qty")))
    pairs = [*LANE, ("low", "rate_low")]
    rated = lookup(bounded, card.withColumn("rate_low", F.col("minm_wgh_qty")), pairs, also=rate_holds_weight)
    return rated.withColumn("gap", F.abs(F.col("weight") - F.col("low"))).drop("low", "above")


def smallest_gap_per_order(rated: DataFrame) -> DataFrame:
    """Rows with the smallest gap of their order id, ties kept.

    The smallest gap of an id is an aggregate with partial sums. Rows meet it by id and gap, so the rows of a hot id
    are spread over its gaps, and adaptive execution splits what is still large.
    """
    least = rated.groupBy(F.col("order_id").alias("least_id")).agg(F.min("gap").alias("least_gap"))
    same = F.col("order_id").eqNullSafe(F.col("least_id")) & (F.col("gap") == F.col("least_gap"))
    return rated.join(least, same).select(*rated.columns)


def first_per_order(rows: DataFrame, lead: tuple[str, ...] = ("gap", *RATE_ORDER)) -> DataFrame:
    """One row per order id: the first in the order of `lead`, then of the remaining columns.

    An aggregate rather than a window, so rows of a hot id are merged before the shuffle, at the price of a sort in
    each task, as the least of several columns has no hash aggregate.
    """
    rest = [c for c in rows.columns if c not in lead and c != "order_id"]
    lead = tuple(c for c in lead if c in rows.columns)
    first = rows.groupBy("order_id").agg(F.min(F.struct(*lead, *rest)).alias("first"))
    return first.select("order_id", "first.*").select(*rows.columns)


def unrated_orders(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Orders without any rate for their lane and weight."""
    lanes = lane_ranges(rates)
    ranged = _ranged(orders, lanes, how="left")
    unheld = lookup(ranged, winning_bounds(rates, lanes), RANGED_LANE, how="left_anti", also=segment_holds_weight)
    return unheld.select(*orders.columns)
