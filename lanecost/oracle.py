"""DuckDB statements that state each registered query independently, from the plain definitions."""

from __future__ import annotations

from .catalog import AMOUNTS, NUDGE, decimals
from .tpch import BANDS

_BAND_ROWS = ", ".join(
    f"('{c}', '{m}', {low}::DOUBLE, {high}::DOUBLE, {base}::DOUBLE)" for c, m, low, high, base in BANDS
)

_NUM = r"regexp_replace(CAST({0} AS VARCHAR), '\.0$', '')"
_BAND = f"coalesce({_NUM.format('minm_wgh_qty')}, 'NA') || ' - ' || coalesce({_NUM.format('max_wgh_qty')}, 'NA')"


def _strict(agg: str, c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN {agg}({c}) END"


def _strict_over(c: str, window: str) -> str:
    return f"CASE WHEN count({c}) OVER ({window}) = count(*) OVER ({window}) THEN sum({c}) OVER ({window}) END"


# Input tables and marts; DuckDB evaluates only the ones a statement reads.
BASE = f"""
WITH lines AS (
  SELECT l_orderkey, sum(l_quantity) AS q, min(l_suppkey) AS sk, min(l_partkey) AS pk, min(l_shipdate) AS sd
  FROM lineitem GROUP BY l_orderkey
), raw_orders AS (
  SELECT *, 'V44_' || substr(o_orderpriority, 1, 1) AS made_carrier,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(sd AS DATE)) AS INTEGER) AS delay
  FROM orders
  JOIN lines ON o_orderkey = l_orderkey
  LEFT JOIN supplier ON sk = s_suppkey
  LEFT JOIN part ON pk = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
), order_list AS (
  SELECT o_orderkey + 1 AS order_id,
         CAST(o_orderdate AS DATE) AS order_date,
         'PORT' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') AS origin_port,
         made_carrier AS carrier,
         CAST(p_size % 3 + 1 AS INTEGER) AS tpt,
         CASE WHEN made_carrier = 'V44_3' THEN 'CRF'
              WHEN o_orderstatus = 'F' THEN 'DTD'
              WHEN o_orderstatus = 'O' THEN 'DTP'
              WHEN o_orderstatus = 'P' THEN 'CRF' END AS service_level,
         CASE WHEN delay < 0 THEN -delay ELSE 0 END AS ship_ahead_day_count,
         CASE WHEN delay > 0 THEN delay ELSE 0 END AS ship_late_day_count,
         c_name AS customer,
         pk + 1 AS product_id,
         'PLANT' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') AS plant_code,
         'PORT' || lpad(CAST(c_nationkey % 5 + 1 AS VARCHAR), 2, '0') AS destination_port,
         CAST(q AS DOUBLE) AS unit_quantity,
         CAST(q * p_size / 10 AS DOUBLE) AS weight
  FROM raw_orders
), repeated_orders AS (
  SELECT * REPLACE (product_id AS order_id) FROM order_list
), bands(carrier, mode_dsc, minm_wgh_qty, max_wgh_qty, base) AS (
  VALUES {_BAND_ROWS}
), freight_rates AS (
  SELECT 'PORT' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS orig_port_cd,
         'PORT' || lpad(CAST(dest + 1 AS VARCHAR), 2, '0') AS dest_port_cd,
         carrier, svc_cd, mode_dsc, minm_wgh_qty, max_wgh_qty,
         base * (1 + n_nationkey % 4) / 10 AS rate,
         CAST(20 + dest AS DOUBLE) AS minimum_cost
  FROM nation, range(0, 5) AS d(dest), (VALUES ('DTD'), ('DTP')) AS s(svc_cd), bands
), clean_rates AS (
  SELECT DISTINCT * FROM freight_rates
), wh_costs AS (
  SELECT 'PLANT' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS wh,
         CAST(0.4 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n_nationkey AS cost_unit,
         2013 AS year, 5 AS month
  FROM nation
), wh_capacities AS (
  SELECT 'PLANT' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS plant_id,
         CAST(200 + 50 * n_nationkey AS DOUBLE) AS daily_capacity,
         'ALL' AS region, 'MAIN' AS type, 'ACTIVE' AS status
  FROM nation
), joined AS (
  SELECT o.*, r.mode_dsc, r.minm_wgh_qty, r.max_wgh_qty, r.rate, r.minimum_cost,
         CASE WHEN r.minimum_cost IS NOT NULL AND o.weight * r.rate IS NOT NULL
              THEN greatest(r.minimum_cost, o.weight * r.rate) END AS freight
  FROM order_list o LEFT JOIN clean_rates r
    ON o.carrier = r.carrier AND o.origin_port = r.orig_port_cd
   AND o.destination_port = r.dest_port_cd AND o.service_level = r.svc_cd
), fitting AS (
  SELECT *, abs(weight - minm_wgh_qty) AS gap, {_BAND} AS weight_band
  FROM joined WHERE weight >= minm_wgh_qty AND weight <= max_wgh_qty
), best AS (
  SELECT *, freight AS shipping_cost FROM fitting
  QUALIFY rank() OVER (PARTITION BY order_id ORDER BY gap) = 1
), best_first AS (
  SELECT *, freight AS shipping_cost FROM fitting
  QUALIFY row_number() OVER (PARTITION BY order_id
    ORDER BY gap, minm_wgh_qty, max_wgh_qty, mode_dsc, rate, minimum_cost) = 1
), repeated_fitting AS (
  SELECT * REPLACE (product_id AS order_id) FROM fitting
), repeated_best AS (
  SELECT *, freight AS shipping_cost FROM repeated_fitting
  QUALIFY rank() OVER (PARTITION BY order_id ORDER BY gap) = 1
), repeated_best_first AS (
  SELECT *, freight AS shipping_cost FROM repeated_fitting
  QUALIFY row_number() OVER (PARTITION BY order_id
    ORDER BY gap, minm_wgh_qty, max_wgh_qty, mode_dsc, rate, minimum_cost,
             carrier, origin_port, destination_port, service_level, weight) = 1
), domain(weight_band, weight_band_ord) AS (
  VALUES ('0 - 99.99', 1), ('0.01 - 0.5', 2), ('0.51 - 1', 3), ('1.01 - 1.5', 4), ('1.51 - 2', 5),
         ('2.01 - 2.5', 6), ('70.51 - 99.99', 7), ('100 - 249.99', 8), ('100 - 299.99', 9),
         ('250 - 499.99', 10), ('300 - 499.99', 11), ('500 - 1999.99', 12), ('0 - 5000', 13)
), mart_all AS (
  SELECT 'all' AS kind, * FROM best
  UNION ALL SELECT 'first', * FROM best_first
  UNION ALL SELECT 'repeated', * FROM repeated_best
), marts AS (
  SELECT kind, origin_port, destination_port, carrier, weight_band, mode_dsc,
         {_strict('sum', 'shipping_cost')} AS total_shipping_cost,
         {_strict('sum', 'weight')} AS total_weight,
         count(*) AS n_orders
  FROM mart_all GROUP BY ALL
), priced AS (
  SELECT m.*, total_shipping_cost / nullif(total_weight, 0) AS avg_cost_per_kg, weight_band_ord
  FROM marts m LEFT JOIN domain USING (weight_band)
), shipping AS (
  SELECT * EXCLUDE (kind) FROM priced WHERE kind = 'all'
), costs AS (
  SELECT p.*, cost_unit, year, month, total_units * cost_unit AS storage_cost,
         total_units * cost_unit / nullif(total_units, 0) AS cost_per_unit,
         total_units * cost_unit / nullif(total_weight, 0) AS cost_per_kg
  FROM (SELECT plant_code, count(*) AS total_orders, {_strict('sum', 'weight')} AS total_weight,
               {_strict('sum', 'unit_quantity')} AS total_units
        FROM order_list GROUP BY plant_code) p
  LEFT JOIN wh_costs ON plant_code = wh
), missing_costs AS (
  SELECT plant_code, total_orders, total_weight, total_units, year, month,
         CASE WHEN plant_code <> 'PLANT25' THEN cost_unit END AS cost_unit,
         CASE WHEN plant_code <> 'PLANT25' THEN storage_cost END AS storage_cost,
         CASE WHEN plant_code <> 'PLANT25' THEN cost_per_unit END AS cost_per_unit,
         CASE WHEN plant_code <> 'PLANT25' THEN cost_per_kg END AS cost_per_kg
  FROM costs
), capacity AS (
  SELECT plant_code, n, daily_capacity, region, type, status,
         n / nullif(daily_capacity, 0) AS capacity_utilization
  FROM (SELECT plant_code, count(*) AS n FROM order_list GROUP BY plant_code)
  LEFT JOIN wh_capacities ON plant_code = plant_id
), lane_rows AS (
  SELECT carrier, weight_band, service_level,
         {_strict('sum', 'weight')} AS total_weight, count(*) AS total_orders,
         {_strict('sum', 'weighted')} AS total_cost
  FROM (SELECT *, {_BAND} AS weight_band, weight * rate AS weighted FROM joined)
  WHERE service_level IS NOT NULL GROUP BY ALL
), mix AS (
  SELECT *, total_cost / nullif(total_weight, 0) AS avg_cost_per_kg,
         total_orders / sum(total_orders) OVER (PARTITION BY carrier, weight_band) * 100 AS pct_orders
  FROM lane_rows
), costed AS (
  SELECT *, CASE WHEN service_level <> 'CRF' THEN coalesce(freight, 0) END AS shipping_cost FROM joined
), first_costed AS (
  SELECT * FROM costed
  QUALIFY row_number() OVER (PARTITION BY order_id
    ORDER BY minm_wgh_qty, max_wgh_qty, mode_dsc, rate, minimum_cost) = 1
), repeated_first_costed AS (
  SELECT * FROM (SELECT * REPLACE (product_id AS order_id) FROM first_costed)
  QUALIFY row_number() OVER (PARTITION BY order_id
    ORDER BY order_date NULLS FIRST, minm_wgh_qty NULLS FIRST, max_wgh_qty NULLS FIRST, mode_dsc NULLS FIRST,
             rate NULLS FIRST, minimum_cost NULLS FIRST, service_level NULLS FIRST, weight NULLS FIRST,
             carrier NULLS FIRST, origin_port NULLS FIRST, destination_port NULLS FIRST,
             shipping_cost NULLS FIRST) = 1
)
"""


def _select(sql: str, keys: str = "", doubles: str = "") -> str:
    """Statement over `sql` that keeps `keys` and rounds `doubles`."""
    columns = [k.strip() for k in keys.split(",") if k.strip()]
    for c in (d.strip() for d in doubles.split(",")):
        if c:
            nudge = 0 if c in AMOUNTS else NUDGE
            columns.append(f"round({c} + {nudge}::DOUBLE, {decimals(c)}) AS {c}")
    return f"{BASE}\nSELECT {', '.join(columns)} FROM ({sql}) AS answer"


MART_KEYS = "origin_port, destination_port, carrier, weight_band, mode_dsc, n_orders, weight_band_ord"
MART_DOUBLES = "total_shipping_cost, total_weight, avg_cost_per_kg"
COST_KEYS = "plant_code, total_orders, year, month"
COST_DOUBLES = "total_weight, total_units, cost_unit, storage_cost, cost_per_unit, cost_per_kg"
CAPACITY_KEYS = "plant_code, n, region, type, status"
CAPACITY_DOUBLES = "daily_capacity, capacity_utilization"
RATED_KEYS = "order_id, mode_dsc, weight_band"
ORDER_KEYS = (
    "order_id, order_date, origin_port, carrier, tpt, service_level, ship_ahead_day_count, "
    "ship_late_day_count, customer, product_id, plant_code, destination_port"
)
ORDER_DOUBLES = "unit_quantity, weight"

_DOLLAR = "CASE WHEN {0} < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', round_even(round(abs({0}), 6), 2))"
_DOLLAR0 = "CASE WHEN {0} < 0 THEN '-$' ELSE '$' END || format('{{:,.0f}}', round_even(round(abs({0}), 6), 0))"
_COMMA = "format('{{:,}}', CAST({0} AS BIGINT))"


def _dollar_auto(c: str) -> str:
    return f"CASE WHEN abs({c}) < 100000 AND round({c}, 6) <> floor(round({c}, 6)) THEN {_DOLLAR.format(c)} ELSE {_DOLLAR0.format(c)} END"


def _percent_text(c: str) -> str:
    return _NUM.format(f"round_even(round({c}, 6), 1)") + " || '%'"


def _shown(c: str, text: str) -> str:
    return f"coalesce(CASE WHEN {c} IS NOT NULL THEN {text} END, 'No data') AS {c}_text"


_ROUTES = f"""
  SELECT origin_port, destination_port, carrier, mode_dsc,
         {_strict('sum', 'total_shipping_cost')} AS total_shipping_cost,
         CAST(sum(n_orders) AS BIGINT) AS n_orders
  FROM shipping {{0}} GROUP BY ALL
"""
_ROUTE_LABELS = f"""
  SELECT *, origin_port || ' → ' || destination_port || chr(10) || carrier AS route_label,
         {_DOLLAR0.format('total_shipping_cost')} AS cost_label,
         {_DOLLAR0.format('total_shipping_cost')} || chr(10) || '(' || {_COMMA.format('n_orders')}
           || ' orders)' AS label_text
  FROM ({_ROUTES.format('')})
"""
_MODES = f"""
  SELECT *, total_cost / total_orders AS avg_cost_per_order FROM (
    SELECT mode_dsc, {_strict('sum', 'total_shipping_cost')} AS total_cost,
           CAST(sum(n_orders) AS BIGINT) AS total_orders,
           {_strict('sum', 'total_weight')} AS total_weight
    FROM shipping GROUP BY mode_dsc)
"""


def _levels(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, count(*) AS orders, {_strict('sum', 'weight')} AS total_weight,
             coalesce(sum(shipping_cost), 0) AS total_cost
      FROM {source} GROUP BY ALL"""


_UNIT_COST = """CASE WHEN service_level <> 'CRF' THEN total_cost / nullif({0}, 0) END"""


def _service_summary(source: str) -> str:
    return f"""
      SELECT service_level, orders, total_weight, total_cost,
             total_weight / orders AS avg_weight_per_order,
             {_UNIT_COST.format('orders')} AS avg_cost_per_order,
             {_UNIT_COST.format('total_weight')} AS avg_cost_per_kg,
             orders / sum(orders) OVER () * 100 AS pct_orders,
             total_weight / sum(total_weight) OVER () * 100 AS pct_weight,
             CASE WHEN service_level = 'CRF' THEN 0 ELSE
               total_cost / sum(CASE WHEN service_level <> 'CRF' THEN total_cost END) OVER () * 100
             END AS pct_cost
      FROM ({_levels(source, 'service_level')})"""


SUMMARY_DOUBLES = (
    "total_weight, total_cost, avg_weight_per_order, avg_cost_per_order, avg_cost_per_kg, "
    "pct_orders, pct_weight, pct_cost"
)


def _breakdown_chart(source: str) -> str:
    return f"""
      WITH wide AS (
        SELECT replace(origin_port, 'PORT', 'PLANT') AS plant_code,
               {_strict('sum', 'total_shipping_cost')} AS transport, any_value(storage_cost) AS storage
        FROM shipping LEFT JOIN (SELECT plant_code, storage_cost FROM {source}) c
          ON c.plant_code = replace(origin_port, 'PORT', 'PLANT')
        GROUP BY 1
      ), long AS (
        SELECT plant_code, transport + storage AS total_cost, 'Transport Cost' AS cost_type,
               transport AS amount FROM wide
        UNION ALL
        SELECT plant_code, transport + storage, 'Storage Cost', storage FROM wide
      )
      SELECT *, amount / {_strict_over('amount', '')} * 100 AS pct_of_total FROM long"""


def _breakdown_export(key: str) -> str:
    return f"""
      SELECT *,
             CASE WHEN total_cost > 0 THEN transport_cost / total_cost * 100
                  WHEN total_cost <= 0 THEN 0 END AS pct_transport,
             CASE WHEN total_cost > 0 THEN storage_cost / total_cost * 100
                  WHEN total_cost <= 0 THEN 0 END AS pct_storage
      FROM (
        SELECT origin_port, coalesce(sum(total_shipping_cost), 0) AS transport_cost,
               max(storage_cost) AS storage_cost,
               coalesce(sum(total_shipping_cost), 0) + max(storage_cost) AS total_cost
        FROM shipping LEFT JOIN (SELECT plant_code, storage_cost FROM costs) c
          ON c.plant_code = {key}
        GROUP BY origin_port)"""


def _quadrants(rows: str, base: str) -> str:
    return f"""
      SELECT plant_code, cost_per_unit, cost_per_kg, total_units, total_orders,
             CASE WHEN cost_per_unit >= mu AND cost_per_kg >= mk THEN 'High Cost'
                  WHEN cost_per_unit < mu AND cost_per_kg < mk THEN 'Optimal'
                  WHEN cost_per_unit >= mu AND cost_per_kg < mk THEN 'High Unit Cost'
                  ELSE 'High KG Cost' END AS quadrant
      FROM {rows}, (SELECT {_strict('median', 'cost_per_unit')} AS mu,
                           {_strict('median', 'cost_per_kg')} AS mk FROM {base})"""


QUADRANT = ("plant_code, total_orders, quadrant", "cost_per_unit, cost_per_kg, total_units")


def _scores(source: str, strict: bool) -> str:
    """Scores by the min-max rule; a strict column is null as soon as one plant lacks it."""

    def score(c: str) -> str:
        value = f"(max({c}) OVER () - {c}) / nullif(max({c}) OVER () - min({c}) OVER (), 0)"
        flat = f"CASE WHEN {c} IS NOT NULL THEN 0.5 END"
        value = f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN {flat} ELSE {value} END"
        if strict:
            value = f"CASE WHEN count({c}) OVER () = count(*) OVER () THEN {value} END"
        return value

    return f"""
      SELECT plant_code, {score('storage_cost')} AS storage_efficiency,
             {score('cost_per_unit')} AS unit_cost_efficiency,
             {score('cost_per_kg')} AS kg_cost_efficiency,
             (total_units - min(total_units) OVER ())
               / (max(total_units) OVER () - min(total_units) OVER ()) AS volume_efficiency
      FROM {source}"""


def _scores_long(source: str) -> str:
    names = {
        "storage_efficiency": "Storage",
        "unit_cost_efficiency": "Unit Cost",
        "kg_cost_efficiency": "Kg Cost",
        "volume_efficiency": "Volume",
    }
    parts = " UNION ALL ".join(
        f"SELECT plant_code, '{label}' AS metric, {c} AS score FROM scores" for c, label in names.items()
    )
    return f"""
      WITH scores AS ({_scores(source, strict=True)})
      SELECT *, CASE WHEN score >= 0.75 THEN 'Excellent' WHEN score >= 0.5 THEN 'Good'
                     WHEN score >= 0.25 THEN 'Fair' ELSE 'Needs Improvement' END AS performance
      FROM ({parts})"""


def _zscores() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT plant_code, storage_cost, cost_per_unit, cost_per_kg, '{name}' AS metric,
                   ({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS score FROM costs"""
        for name, c in (
            ("storage_efficiency", "storage_cost"),
            ("unit_efficiency", "cost_per_unit"),
            ("kg_efficiency", "cost_per_kg"),
        )
    )
    return parts


# Key figures over a filtered mart ({0} is a WHERE clause)
_TOTAL_COST = f"""SELECT total_cost, {_shown('total_cost', _DOLLAR.format('total_cost'))}
  FROM (SELECT coalesce(sum(total_shipping_cost), 0) AS total_cost FROM shipping {{0}})"""
_COST_KG = f"""SELECT avg_cost_kg, {_shown('avg_cost_kg', _DOLLAR.format('avg_cost_kg'))}
  FROM (SELECT sum(total_shipping_cost) / nullif(sum(total_weight), 0) AS avg_cost_kg FROM shipping {{0}})"""
_UTIL = f"""SELECT warehouse_util, {_shown('warehouse_util', _percent_text('warehouse_util'))}
  FROM (SELECT avg(capacity_utilization) * 100 AS warehouse_util FROM capacity {{0}})"""
_ON_TIME = f"""SELECT otd_rate, {_shown('otd_rate', _percent_text('otd_rate'))}
  FROM (SELECT round_even(count(*) * 0.942::DOUBLE, 0) / nullif(count(*), 0) * 100 AS otd_rate
        FROM order_list {{0}})"""
_STORAGE = f"""SELECT total_storage_cost, {_shown('total_storage_cost', _dollar_auto('total_storage_cost'))}
  FROM (SELECT nullif(coalesce(sum(storage_cost), 0), 0) AS total_storage_cost FROM costs)"""
_UNIT = f"""SELECT avg_cost_unit, {_shown('avg_cost_unit', _dollar_auto('avg_cost_unit'))}
  FROM (SELECT nullif(avg(cost_per_unit), 0) AS avg_cost_unit FROM costs)"""
_GROUND = f"""SELECT ground_pct, {_shown('ground_pct', _percent_text('ground_pct'))}
  FROM (SELECT CASE WHEN count(*) FILTER (mode_dsc = 'GROUND') > 0 THEN
          coalesce(sum(total_shipping_cost) FILTER (mode_dsc = 'GROUND'), 0)
            / nullif(sum(total_shipping_cost), 0) * 100 END AS ground_pct FROM shipping {{0}})"""
_TOP_ROUTE = """SELECT origin_port || ' → ' || destination_port AS top_route, total_cost
  FROM (SELECT origin_port, destination_port, coalesce(sum(total_shipping_cost), 0) AS total_cost
        FROM shipping {0} GROUP BY ALL ORDER BY total_cost DESC, origin_port, destination_port LIMIT 1)
  WHERE total_cost <> 0"""

_BY_CARRIER = "plant_code IN (SELECT plant_code FROM order_list WHERE carrier = '{0}')"


def _where(statement: str, clause: str) -> str:
    return statement.replace("{0}", clause)


def _overview(shipping: str, capacity: str, orders: str) -> str:
    parts = (_where(_TOTAL_COST, shipping), _where(_COST_KG, shipping), _where(_UTIL, capacity), _where(_ON_TIME, orders))
    return "SELECT * FROM " + ", ".join(f"({p})" for p in parts)


def _cost_figures(shipping: str) -> str:
    parts = ", ".join(f"({p})" for p in (_STORAGE, _UNIT, _where(_GROUND, shipping)))
    route = f"coalesce((SELECT top_route FROM ({_where(_TOP_ROUTE, shipping)})), 'No data') AS top_route"
    return f"SELECT *, {route} FROM {parts}"


OVERVIEW = ("total_cost_text, avg_cost_kg_text, warehouse_util_text, otd_rate_text",
            "total_cost, avg_cost_kg, warehouse_util, otd_rate")
COST_FIGURES = ("total_storage_cost_text, avg_cost_unit_text, ground_pct_text, top_route",
                "total_storage_cost, avg_cost_unit, ground_pct")

# The tables with bad and missing values by a fixed rule.
SEEDED_ORDERS = """(SELECT * REPLACE (
    CASE WHEN order_id % 61 = 0 THEN -order_id ELSE order_id END AS order_id,
    CASE WHEN order_id % 97 = 0 THEN 0 ELSE weight END AS weight,
    CASE WHEN order_id % 89 = 0 THEN -1 ELSE unit_quantity END AS unit_quantity,
    CASE WHEN order_id % 83 = 0 THEN -2 ELSE ship_ahead_day_count END AS ship_ahead_day_count,
    CASE WHEN order_id % 79 = 0 THEN -1 ELSE ship_late_day_count END AS ship_late_day_count,
    CASE WHEN order_id % 73 <> 0 THEN service_level END AS service_level,
    CASE WHEN order_id % 71 <> 0 THEN origin_port END AS origin_port,
    CASE WHEN order_id % 67 <> 0 THEN order_date END AS order_date) FROM order_list)"""
SEEDED_RATES = """(SELECT * REPLACE (
    CASE WHEN orig_port_cd = 'PORT02' THEN -rate ELSE rate END AS rate,
    CASE WHEN orig_port_cd = 'PORT03' THEN -1 ELSE minimum_cost END AS minimum_cost,
    CASE WHEN orig_port_cd = 'PORT04' THEN minm_wgh_qty - 1 ELSE max_wgh_qty END AS max_wgh_qty,
    CASE WHEN orig_port_cd = 'PORT05' THEN 'RAIL' ELSE mode_dsc END AS mode_dsc,
    CASE WHEN orig_port_cd <> 'PORT06' THEN svc_cd END AS svc_cd) FROM freight_rates)"""

CHECK_KEYS = '"check", severity, "column", n_bad, detail'


def _check(check: str, severity: str, column: str, n_bad: str, source: str, detail: str = "NULL") -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{severity}' AS severity, '{column}' AS \"column\", "
        f"CAST({n_bad} AS BIGINT) AS n_bad, CAST({detail} AS VARCHAR) AS detail FROM {source}"
    )


def _rules(check: str, source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        _check(check, "ERROR", c, f"count(*) FILTER (NOT coalesce({rule}, false))", source)
        for c, rule in rules.items()
    )


def _outliers(column: str, low: float, high: float) -> str:
    out = f"{column} < {low} OR {column} > {high}"
    shown = "format('{{:,.2f}}', {0}({1}) FILTER ({2}))"
    detail = f"{shown.format('min', column, out)} || ' to ' || {shown.format('max', column, out)}"
    return _check("outliers", "WARN", column, f"count(*) FILTER ({out})", "shipping", detail)


def _duplicates(keys: str, source: str) -> str:
    groups = f"(SELECT count(*) AS k FROM {source} GROUP BY {keys} HAVING count(*) > 1)"
    return _check("duplicate records", "WARN", keys, "coalesce(sum(k), 0)", groups)


def _nulls(check: str, columns: tuple[str, ...], source: str) -> list[str]:
    return [_check(check, "WARN", c, f"count(*) FILTER ({c} IS NULL)", source) for c in columns]




def statements() -> dict[str, str]:
    s: dict[str, str] = {}

    # sources
    s["order_list"] = _select("SELECT * FROM order_list", ORDER_KEYS, ORDER_DOUBLES)
    s["freight_rate_card"] = _select(
        "SELECT DISTINCT * FROM freight_rates",
        "orig_port_cd, dest_port_cd, carrier, svc_cd, mode_dsc",
        "minm_wgh_qty, max_wgh_qty, rate, minimum_cost",
    )
    s["warehouse_cost_table"] = _select("SELECT * FROM wh_costs", "wh, year, month", "cost_unit")
    s["warehouse_capacity_table"] = _select(
        "SELECT * FROM wh_capacities",
        "plant_id, region, type, status",
        "daily_capacity",
    )

    # rating
    rated = (RATED_KEYS, "rate, gap, shipping_cost")
    s["rates_in_band"] = _select("SELECT * FROM fitting", RATED_KEYS, "rate, gap")
    s["best_rates"] = _select("SELECT * FROM best", *rated)
    s["best_rates_first"] = _select("SELECT * FROM best_first", *rated)
    s["best_rates_repeated_ids"] = _select("SELECT * FROM repeated_best", *rated)
    s["best_rates_first_repeated_ids"] = _select("SELECT * FROM repeated_best_first", *rated)
    s["unrated_orders"] = _select(
        "SELECT * FROM order_list WHERE order_id NOT IN (SELECT order_id FROM fitting)",
        "order_id, carrier",
        "weight",
    )
    s["service_costing"] = _select(
        "SELECT * FROM costed",
        "order_id, service_level, mode_dsc",
        "minm_wgh_qty, max_wgh_qty, rate, shipping_cost",
    )

    # marts
    for name, kind in (
        ("shipping_costs", "all"),
        ("shipping_costs_first_rate", "first"),
        ("shipping_costs_repeated_ids", "repeated"),
    ):
        s[name] = _select(f"SELECT * FROM priced WHERE kind = '{kind}'", MART_KEYS, MART_DOUBLES)
    s["warehouse_costs"] = _select("SELECT * FROM costs", COST_KEYS, COST_DOUBLES)
    s["warehouse_costs_in_period"] = _select(
        """SELECT plant_code, total_orders, total_weight, total_units, 2014 AS year, 1 AS month,
                  cost_unit * 1.5::DOUBLE AS cost_unit, total_units * (cost_unit * 1.5::DOUBLE) AS storage_cost,
                  total_units * (cost_unit * 1.5::DOUBLE) / total_units AS cost_per_unit,
                  total_units * (cost_unit * 1.5::DOUBLE) / total_weight AS cost_per_kg FROM costs""",
        COST_KEYS,
        COST_DOUBLES,
    )
    s["warehouse_costs_per_order"] = _select(
        "SELECT *, storage_cost / total_orders AS cost_per_order FROM costs",
        COST_KEYS,
        "total_weight, total_units, cost_unit, storage_cost, cost_per_order, cost_per_kg",
    )
    s["warehouse_capacity"] = _select("SELECT * FROM capacity", CAPACITY_KEYS, CAPACITY_DOUBLES)
    s["shipping_state_by_day"] = f"""{BASE}
        SELECT origin_port, destination_port, carrier, weight_band, mode_dsc, order_date, count(*) AS n_rows,
               count(shipping_cost) AS shipping_cost_known, count(weight) AS weight_known,
               round(sum(shipping_cost) + {NUDGE}::DOUBLE, 8) AS shipping_cost_sum,
               round(sum(weight) + {NUDGE}::DOUBLE, 8) AS weight_sum
        FROM best GROUP BY ALL"""
    for days, whole in (
        ("shipping_costs_of_days", "shipping_costs"),
        ("shipping_costs_of_merged_days", "shipping_costs"),
        ("warehouse_costs_of_days", "warehouse_costs"),
        ("warehouse_capacity_of_days", "warehouse_capacity"),
    ):
        s[days] = s[whole]
    share = "format('{:,.1f}', round_even(round(capacity_utilization * 100, 6), 1)) || '%'"
    s["capacity_status"] = _select(
        f"""SELECT * REPLACE (CASE WHEN capacity_utilization >= 1 THEN 'Over Capacity'
                                  ELSE 'Under Capacity' END AS status),
                  capacity_utilization * 100 AS utilization_pct, {share} AS util_label,
                  {share} || chr(10) || {_COMMA.format('n')} || ' orders' AS detail_label
            FROM capacity""",
        CAPACITY_KEYS + ", util_label, detail_label",
        CAPACITY_DOUBLES + ", utilization_pct",
    )

    # filters
    for name, where in (
        ("shipping_of_plant", "origin_port = 'PORT03'"),
        ("shipping_of_plant_and_carrier", "origin_port = 'PORT03' AND carrier = 'V44_1'"),
        ("shipping_of_raw_plant_code", "origin_port = 'PLANT03'"),
    ):
        s[name] = _select(f"SELECT * FROM shipping WHERE {where}", MART_KEYS, MART_DOUBLES)
    s["storage_of_plant"] = _select(
        "SELECT * FROM costs WHERE plant_code = 'PLANT03'", COST_KEYS, COST_DOUBLES
    )
    s["storage_of_carrier"] = _select(
        f"SELECT * FROM costs WHERE {_BY_CARRIER.format('V44_2')}", COST_KEYS, COST_DOUBLES
    )
    s["orders_filtered"] = _select(
        "SELECT * FROM order_list WHERE plant_code = 'PLANT03' AND carrier = 'V44_1' AND service_level = 'DTD'",
        ORDER_KEYS,
        ORDER_DOUBLES,
    )
    s["capacity_of_carrier"] = _select(
        f"SELECT * FROM capacity WHERE plant_code = 'PLANT03' AND {_BY_CARRIER.format('V44_1')}",
        CAPACITY_KEYS,
        CAPACITY_DOUBLES,
    )
    s["filter_choices"] = _select(
        " UNION ".join(
            f"""SELECT '{f}' AS filter, 'All' AS choice, 0 AS position
                UNION SELECT '{f}', {c}, 1 FROM order_list WHERE {c} IS NOT NULL"""
            for f, c in (
                ("warehouse", "plant_code"),
                ("carrier", "carrier"),
                ("service_level", "service_level"),
            )
        ),
        "filter, choice, position",
    )
    s["filter_audit"] = _select(
        """SELECT 'warehouse=PLANT03; carrier=V44_1; service_level=All' AS filters_applied,
                  count(*) AS rows_before,
                  count(*) FILTER (plant_code = 'PLANT03' AND carrier = 'V44_1') AS rows_after
           FROM order_list""",
        "filters_applied, rows_before, rows_after",
    )

    # shipping summaries
    route = "origin_port, destination_port, carrier, mode_dsc, n_orders"
    s["route_export"] = _select(
        f"""SELECT *, 'warehouse=All; carrier=V44_2; service_level=All' AS filters_applied
            FROM ({_ROUTES.format("WHERE carrier = 'V44_2'")})""",
        route + ", filters_applied",
        "total_shipping_cost",
    )
    s["route_summary"] = _select(
        f"""SELECT *, total_shipping_cost / sum(total_shipping_cost) OVER () * 100 AS pct_of_total,
                   total_shipping_cost / n_orders AS avg_cost_per_order
            FROM ({_ROUTES.format('')})""",
        route,
        "total_shipping_cost, pct_of_total, avg_cost_per_order",
    )
    s["route_labels"] = _select(
        _ROUTE_LABELS, route + ", route_label, cost_label, label_text", "total_shipping_cost"
    )
    s["route_order"] = _select(
        f"""SELECT route_label, median(total_shipping_cost) AS sort_value
            FROM ({_ROUTE_LABELS}) GROUP BY route_label""",
        "route_label",
        "sort_value",
    )
    s["transport_export"] = _select(
        _MODES, "mode_dsc, total_orders", "total_cost, total_weight, avg_cost_per_order"
    )
    s["transport_mode_summary"] = _select(
        f"""SELECT *, total_cost / sum(total_cost) OVER () * 100 AS pct_of_total,
                   total_cost / total_weight AS avg_cost_per_kg FROM ({_MODES})""",
        "mode_dsc, total_orders",
        "total_cost, total_weight, avg_cost_per_order, pct_of_total, avg_cost_per_kg",
    )
    s["shipping_shares"] = _select(
        """SELECT *, total_shipping_cost / sum(total_shipping_cost) OVER () * 100 AS pct_total_cost,
                  n_orders / sum(n_orders) OVER () * 100 AS pct_total_orders FROM shipping""",
        "origin_port, destination_port, carrier, weight_band, mode_dsc, n_orders",
        "total_shipping_cost, pct_total_cost, pct_total_orders",
    )
    s["weight_band_use"] = _select(
        f"""SELECT *, total_weight / total_orders AS avg_weight_per_order,
                   CASE WHEN total_orders > 10000 OR total_weight > 100000
                        THEN carrier || chr(10) || {_COMMA.format('total_orders')} || ' orders'
                        ELSE '' END AS point_label
            FROM (SELECT carrier, weight_band, CAST(sum(n_orders) AS BIGINT) AS total_orders,
                         {_strict('sum', 'total_weight')} AS total_weight
                  FROM shipping GROUP BY ALL)""",
        "carrier, weight_band, total_orders, point_label",
        "total_weight, avg_weight_per_order",
    )
    label = (
        f"{_COMMA.format('n_orders')} || ' orders' || chr(10) || "
        f"{_COMMA.format('round_even(round(total_weight, 6), 0)')} || ' kg'"
    )
    s["weight_band_detail"] = _select(
        f"""SELECT *, {label} AS order_label, total_weight > 10000 AS significant,
                   CASE WHEN total_weight > 10000 THEN {label}
                        WHEN total_weight <= 10000 THEN '' END AS label_text FROM shipping""",
        MART_KEYS + ", order_label, significant, label_text",
        MART_DOUBLES,
    )
    s["weight_band_efficiency"] = _select(
        f"""SELECT carrier, mode_dsc, weight_band,
                   {_strict('sum', 'total_shipping_cost')} AS total_cost,
                   {_strict('sum', 'total_weight')} AS total_weight,
                   CAST(sum(n_orders) AS BIGINT) AS total_orders,
                   {_strict('avg', 'kg')} AS avg_cost_per_kg, {_strict('avg', 'per_order')} AS avg_cost_per_order
            FROM (SELECT *, total_shipping_cost / nullif(total_weight, 0) AS kg,
                         total_shipping_cost / n_orders AS per_order FROM shipping)
            GROUP BY carrier, mode_dsc, weight_band""",
        "carrier, mode_dsc, weight_band, total_orders",
        "total_cost, total_weight, avg_cost_per_kg, avg_cost_per_order",
    )
    s["row_efficiency"] = _select(
        """SELECT *, total_shipping_cost / total_weight AS cost_per_kg,
                  total_shipping_cost / n_orders AS cost_per_order,
                  total_weight / nullif(total_shipping_cost, 0) AS efficiency_score FROM shipping""",
        MART_KEYS,
        MART_DOUBLES + ", cost_per_kg, cost_per_order, efficiency_score",
    )
    s["weight_band_routes"] = _select(
        f"""SELECT origin_port || ' → ' || destination_port AS route, carrier, weight_band,
                   any_value(weight_band_ord) AS weight_band_ord,
                   {_strict('sum', 'total_weight')} AS total_weight,
                   CAST(sum(n_orders) AS BIGINT) AS total_orders,
                   {_strict('avg', 'avg_cost_per_kg')} AS avg_cost_per_kg
            FROM shipping GROUP BY 1, 2, 3""",
        "route, carrier, weight_band, weight_band_ord, total_orders",
        "total_weight, avg_cost_per_kg",
    )
    s["weight_band_service_mix"] = _select(
        "SELECT * FROM mix",
        "carrier, weight_band, service_level, total_orders",
        "total_weight, total_cost, avg_cost_per_kg, pct_orders",
    )
    s["carrier_service_mix"] = _select(
        f"""SELECT *, total_orders / sum(total_orders) OVER (PARTITION BY carrier) * 100 AS pct_orders,
                   total_weight / {_strict_over('total_weight', 'PARTITION BY carrier')} * 100 AS pct_weight
            FROM (SELECT carrier, service_level, CAST(sum(total_orders) AS BIGINT) AS total_orders,
                         {_strict('sum', 'total_weight')} AS total_weight FROM mix GROUP BY ALL)""",
        "carrier, service_level, total_orders",
        "total_weight, pct_orders, pct_weight",
    )
    s["carrier_costs"] = _select(
        f"""SELECT carrier, mode_dsc, {_strict('avg', 'total_shipping_cost')} AS avg_cost,
                   {_strict('sum', 'total_weight')} AS total_volume,
                   sum(total_shipping_cost) / nullif(sum(total_weight), 0) AS cost_per_kg
            FROM shipping GROUP BY carrier, mode_dsc""",
        "carrier, mode_dsc",
        "avg_cost, total_volume, cost_per_kg",
    )

    # service levels
    s["service_distribution"] = _select(
        """SELECT service_level, n, n / sum(n) OVER () * 100 AS percentage
           FROM (SELECT service_level, count(*) AS n FROM order_list GROUP BY service_level)""",
        "service_level, n",
        "percentage",
    )
    s["service_summary"] = _select(
        _service_summary("first_costed"), "service_level, orders", SUMMARY_DOUBLES
    )
    s["service_summary_repeated_ids"] = _select(
        _service_summary("repeated_first_costed"), "service_level, orders", SUMMARY_DOUBLES
    )
    s["carrier_service"] = _select(
        f"""SELECT *, {_UNIT_COST.format('total_weight')} AS avg_cost_per_kg,
                   orders / sum(orders) OVER (PARTITION BY carrier) * 100 AS pct_carrier_orders,
                   total_weight / sum(total_weight) OVER (PARTITION BY carrier) * 100 AS pct_carrier_weight,
                   CASE WHEN service_level = 'CRF' THEN 0 ELSE total_cost / nullif(sum(
                     CASE WHEN service_level <> 'CRF' THEN total_cost END)
                     OVER (PARTITION BY carrier), 0) * 100 END AS pct_carrier_cost
            FROM ({_levels('first_costed', 'carrier, service_level')})""",
        "carrier, service_level, orders",
        "total_weight, total_cost, avg_cost_per_kg, pct_carrier_orders, pct_carrier_weight, pct_carrier_cost",
    )
    s["route_service"] = _select(
        f"""SELECT *, origin_port || ' → ' || destination_port AS route,
                   {_UNIT_COST.format('total_weight')} AS avg_cost_per_kg,
                   CASE WHEN service_level = 'CRF' THEN 0 ELSE total_cost / nullif(sum(
                     CASE WHEN service_level <> 'CRF' THEN total_cost END) OVER (), 0) * 100 END AS pct_cost
            FROM ({_levels('first_costed', 'origin_port, destination_port, service_level')})""",
        "origin_port, destination_port, service_level, orders, route",
        "total_weight, total_cost, avg_cost_per_kg, pct_cost",
    )
    s["carrier_service_repeated_ids"] = _select(
        f"""SELECT *, {_UNIT_COST.format('total_weight')} AS avg_cost_per_kg,
                   orders / sum(orders) OVER (PARTITION BY carrier) * 100 AS pct_carrier_orders,
                   total_weight / sum(total_weight) OVER (PARTITION BY carrier) * 100 AS pct_carrier_weight,
                   CASE WHEN service_level = 'CRF' THEN 0 ELSE total_cost / nullif(sum(
                     CASE WHEN service_level <> 'CRF' THEN total_cost END)
                     OVER (PARTITION BY carrier), 0) * 100 END AS pct_carrier_cost
            FROM ({_levels('repeated_first_costed', 'carrier, service_level')})""",
        "carrier, service_level, orders",
        "total_weight, total_cost, avg_cost_per_kg, pct_carrier_orders, pct_carrier_weight, pct_carrier_cost",
    )
    s["route_service_repeated_ids"] = _select(
        f"""SELECT *, origin_port || ' → ' || destination_port AS route,
                   {_UNIT_COST.format('total_weight')} AS avg_cost_per_kg,
                   CASE WHEN service_level = 'CRF' THEN 0 ELSE total_cost / nullif(sum(
                     CASE WHEN service_level <> 'CRF' THEN total_cost END) OVER (), 0) * 100 END AS pct_cost
            FROM ({_levels('repeated_first_costed', 'origin_port, destination_port, service_level')})""",
        "origin_port, destination_port, service_level, orders, route",
        "total_weight, total_cost, avg_cost_per_kg, pct_cost",
    )
    s["service_cost_efficiency"] = _select(
        f"SELECT * FROM ({_service_summary('first_costed')}) WHERE service_level <> 'CRF'",
        "service_level",
        "avg_cost_per_kg, total_weight",
    )

    # warehouse summaries
    s["storage_ranking"] = _select(
        f"""SELECT *, storage_cost / {_strict_over('storage_cost', '')} * 100 AS pct_of_total FROM (
             SELECT * FROM costs QUALIFY rank() OVER (ORDER BY storage_cost DESC NULLS LAST) <= 10)""",
        COST_KEYS,
        COST_DOUBLES + ", pct_of_total",
    )
    s["storage_ranking_of_all"] = _select(
        """SELECT * FROM (SELECT *, storage_cost / sum(storage_cost) OVER () * 100 AS pct_of_total,
                                 total_units / storage_cost AS efficiency_score FROM costs)
           QUALIFY rank() OVER (ORDER BY storage_cost DESC NULLS LAST) <= 10""",
        COST_KEYS,
        COST_DOUBLES + ", pct_of_total, efficiency_score",
    )
    s["storage_export"] = _select(
        "SELECT * FROM costs", "plant_code", "storage_cost, total_units, cost_per_unit"
    )
    chart = ("plant_code, cost_type", "total_cost, amount, pct_of_total")
    s["cost_breakdown_chart"] = _select(_breakdown_chart("costs"), *chart)
    s["cost_breakdown_chart_known"] = _select(_breakdown_chart("costs"), *chart)
    s["cost_breakdown_chart_missing"] = _select(_breakdown_chart("missing_costs"), *chart)
    wide = ("origin_port", "transport_cost, storage_cost, total_cost, pct_transport, pct_storage")
    s["cost_breakdown_export"] = _select(
        _breakdown_export("replace(origin_port, 'PORT', 'PLANT')"), *wide
    )
    s["cost_breakdown_export_raw_keys"] = _select(_breakdown_export("origin_port"), *wide)
    s["unit_cost_quadrants_chart"] = _select(
        _quadrants("(SELECT * FROM costs WHERE plant_code = 'PLANT03')", "costs"), *QUADRANT
    )
    s["unit_cost_quadrants_export"] = _select(_quadrants("costs", "costs"), *QUADRANT)
    s["unit_cost_quadrants_missing"] = _select(_quadrants("missing_costs", "missing_costs"), *QUADRANT)
    long = ("plant_code, metric, performance", "score")
    s["efficiency_matrix_chart"] = _select(_scores_long("costs"), *long)
    s["efficiency_matrix_chart_missing"] = _select(_scores_long("missing_costs"), *long)
    s["efficiency_matrix_export"] = _select(
        _scores("costs", strict=False),
        "plant_code",
        "storage_efficiency, unit_cost_efficiency, kg_cost_efficiency, volume_efficiency",
    )
    s["standardised_costs"] = _select(
        _zscores(), "plant_code, metric", "storage_cost, cost_per_unit, cost_per_kg, score"
    )

    # key figures
    s["total_shipping_cost"] = _select(_where(_TOTAL_COST, ""), "total_cost_text", "total_cost")
    s["cost_per_kg"] = _select(_where(_COST_KG, ""), "avg_cost_kg_text", "avg_cost_kg")
    s["warehouse_utilisation"] = _select(_where(_UTIL, ""), "warehouse_util_text", "warehouse_util")
    s["on_time_share"] = _select(_where(_ON_TIME, ""), "otd_rate_text", "otd_rate")
    s["measured_on_time_share"] = _select(
        """SELECT count(*) FILTER (ship_late_day_count = 0) / nullif(count(ship_late_day_count), 0) * 100
             AS on_time_rate FROM order_list""",
        "",
        "on_time_rate",
    )
    s["total_storage_cost"] = _select(_STORAGE, "total_storage_cost_text", "total_storage_cost")
    s["mean_cost_per_unit"] = _select(_UNIT, "avg_cost_unit_text", "avg_cost_unit")
    s["ground_share"] = _select(_where(_GROUND, ""), "ground_pct_text", "ground_pct")
    s["costliest_route"] = _select(_where(_TOP_ROUTE, ""), "top_route", "total_cost")
    s["script_figures"] = _select(
        f"""SELECT (SELECT {_strict('sum', 'total_shipping_cost')} FROM shipping) AS total_transport_cost,
                   (SELECT {_strict('avg', 'cost_per_unit')} FROM costs) AS avg_cost_per_unit,
                   (SELECT sum(total_shipping_cost) FILTER (mode_dsc = 'AIR')
                         / sum(total_shipping_cost) FILTER (mode_dsc = 'GROUND') FROM shipping)
                     AS air_ground_ratio""",
        "",
        "total_transport_cost, avg_cost_per_unit, air_ground_ratio",
    )
    s["overview_kpis"] = _select(_overview("", "", ""), *OVERVIEW)
    s["overview_kpis_of_plant"] = _select(
        _overview(
            "WHERE origin_port = 'PORT03' AND carrier = 'V44_1'",
            f"WHERE plant_code = 'PLANT03' AND {_BY_CARRIER.format('V44_1')}",
            "WHERE plant_code = 'PLANT03' AND carrier = 'V44_1'",
        ),
        *OVERVIEW,
    )
    s["overview_kpis_without_rates"] = _select(
        _overview(
            "WHERE carrier = 'V44_3'",
            f"WHERE {_BY_CARRIER.format('V44_3')}",
            "WHERE carrier = 'V44_3'",
        ),
        *OVERVIEW,
    )
    s["cost_kpis"] = _select(_cost_figures(""), *COST_FIGURES)
    s["cost_kpis_without_rates"] = _select(_cost_figures("WHERE carrier = 'V44_3'"), *COST_FIGURES)

    # quality checks
    levels = "('CRF', 'DTD', 'DTP')"
    s["check_order_list"] = _select(
        _rules(
            "order_list",
            "order_list",
            {
                "order_id": "order_id > 0",
                "order_date": "order_date IS NOT NULL",
                "weight": "weight > 0",
                "unit_quantity": "unit_quantity > 0",
                "ship_ahead_day_count": "ship_ahead_day_count >= 0",
                "ship_late_day_count": "ship_late_day_count >= 0",
                "service_level": f"service_level IN {levels}",
            },
        ),
        CHECK_KEYS,
    )
    s["check_freight_rates"] = _select(
        _rules(
            "freight_rates",
            "freight_rates",
            {
                "rate": "rate > 0",
                "minimum_cost": "minimum_cost >= 0",
                "max_wgh_qty": "max_wgh_qty > minm_wgh_qty",
                "mode_dsc": "mode_dsc IN ('AIR', 'GROUND')",
                "svc_cd": f"svc_cd IN {levels}",
            },
        ),
        CHECK_KEYS,
    )
    s["check_order_list_seeded"] = _select(
        _rules(
            "order_list",
            SEEDED_ORDERS,
            {
                "order_id": "order_id > 0",
                "order_date": "order_date IS NOT NULL",
                "weight": "weight > 0",
                "unit_quantity": "unit_quantity > 0",
                "ship_ahead_day_count": "ship_ahead_day_count >= 0",
                "ship_late_day_count": "ship_late_day_count >= 0",
                "service_level": f"service_level IN {levels}",
            },
        ),
        CHECK_KEYS,
    )
    s["check_freight_rates_seeded"] = _select(
        _rules(
            "freight_rates",
            SEEDED_RATES,
            {
                "rate": "rate > 0",
                "minimum_cost": "minimum_cost >= 0",
                "max_wgh_qty": "max_wgh_qty > minm_wgh_qty",
                "mode_dsc": "mode_dsc IN ('AIR', 'GROUND')",
                "svc_cd": f"svc_cd IN {levels}",
            },
        ),
        CHECK_KEYS,
    )
    impossible = {
        "zero or negative weight": ("total_weight", "total_weight <= 0"),
        "negative shipping cost": ("total_shipping_cost", "total_shipping_cost < 0"),
        "infinite cost per kg": ("avg_cost_per_kg", "total_weight = 0 AND total_shipping_cost <> 0"),
    }
    s["check_shipping_metrics"] = _select(
        " UNION ALL ".join(
            [
                *(
                    _check(check, "ERROR", c, f"count(*) FILTER ({bad})", "shipping")
                    for check, (c, bad) in impossible.items()
                ),
                _outliers("avg_cost_per_kg", 0.01, 1000),
                _outliers("total_shipping_cost", 0, 1000000),
                *_nulls(
                    "missing values",
                    ("total_weight", "total_shipping_cost", "avg_cost_per_kg"),
                    "shipping",
                ),
            ]
        ),
        CHECK_KEYS,
    )
    s["check_duplicate_lanes"] = _select(
        _duplicates("origin_port, destination_port, carrier, weight_band", "shipping"), CHECK_KEYS
    )
    s["check_weight_bands"] = _select(
        _check(
            "invalid weight band",
            "ERROR",
            "weight_band",
            "count(*) FILTER (weight_band NOT IN (SELECT weight_band FROM domain))",
            "shipping",
        )
        + " UNION ALL "
        + _nulls("missing weight band", ("weight_band",), "shipping")[0],
        CHECK_KEYS,
    )
    s["check_service_levels"] = _select(
        _check(
            "invalid service level",
            "ERROR",
            "service_level",
            f"count(*) FILTER (service_level IS NULL OR service_level NOT IN {levels})",
            "order_list",
        )
        + " UNION ALL "
        + _check(
            "missing port",
            "ERROR",
            "origin_port, destination_port",
            "count(*) FILTER (origin_port IS NULL OR destination_port IS NULL)",
            "order_list",
        ),
        CHECK_KEYS,
    )
    s["check_service_levels_seeded"] = _select(
        _check(
            "invalid service level",
            "ERROR",
            "service_level",
            f"count(*) FILTER (service_level IS NULL OR service_level NOT IN {levels})",
            SEEDED_ORDERS,
        )
        + " UNION ALL "
        + _check(
            "missing port",
            "ERROR",
            "origin_port, destination_port",
            "count(*) FILTER (origin_port IS NULL OR destination_port IS NULL)",
            SEEDED_ORDERS,
        ),
        CHECK_KEYS,
    )
    s["mart_checks"] = " UNION ALL ".join(
        f"SELECT * FROM ({s[name]})" for name in ("check_shipping_metrics", "check_duplicate_lanes", "check_weight_bands")
    )
    plotted = ("storage_cost", "cost_per_unit", "cost_per_kg", "total_units")
    s["check_plot_data"] = _select(
        " UNION ALL ".join(
            _nulls("NA values", plotted, "costs")
            + [
                _check("negative values", "WARN", c, f"count(*) FILTER ({c} < 0)", "costs")
                for c in plotted[:3]
            ]
        ),
        CHECK_KEYS,
    )
    s["check_relationships"] = _select(
        """SELECT 'orders to capacities' AS relationship, count(*) AS n_rows,
                  count(*) FILTER (plant_code IS NULL OR plant_code NOT IN (SELECT plant_id FROM wh_capacities))
                    AS n_unmatched,
                  count(*) FILTER (plant_code IS NULL OR plant_code NOT IN (SELECT plant_id FROM wh_capacities))
                    = 0 AS valid
           FROM order_list
           UNION ALL
           SELECT 'orders to freight rates', count(DISTINCT order_id),
                  count(DISTINCT order_id) FILTER (mode_dsc IS NULL), count(*) > 0 FROM joined
           UNION ALL
           SELECT 'costs to capacities', count(*),
                  count(*) FILTER (wh NOT IN (SELECT plant_id FROM wh_capacities)),
                  count(*) FILTER (wh NOT IN (SELECT plant_id FROM wh_capacities)) = 0 FROM wh_costs""",
        "relationship, n_rows, n_unmatched, valid",
    )
    s["check_unrated_orders"] = _select(
        """SELECT 'unrated orders' AS "check", 'WARN' AS severity, 'weight' AS "column",
                  count(*) AS n_bad, 'service level ' || service_level AS detail
           FROM order_list WHERE order_id NOT IN (SELECT order_id FROM fitting) GROUP BY service_level""",
        CHECK_KEYS,
    )
    s["order_id_duplicates"] = _select(_duplicates("order_id", "order_list"), CHECK_KEYS)

    s["clipped_costs"] = _select(
        """SELECT plant_code, CASE WHEN third THEN -storage_cost ELSE storage_cost END AS storage_cost,
                  CASE WHEN third THEN least(cost_unit, 0) ELSE cost_unit END AS cost_unit,
                  CASE WHEN third THEN least(cost_per_unit, 0) ELSE cost_per_unit END AS cost_per_unit,
                  CASE WHEN third THEN least(cost_per_kg, 0) ELSE cost_per_kg END AS cost_per_kg
           FROM (SELECT *, CAST(substr(plant_code, 6, 2) AS INTEGER) % 3 = 0 AS third FROM costs)""",
        "plant_code",
        "storage_cost, cost_unit, cost_per_unit, cost_per_kg",
    )
    s["storage_export_of_carrier"] = _select(
        f"SELECT * FROM costs WHERE {_BY_CARRIER.format('V44_2')}", "plant_code", "storage_cost, total_units, cost_per_unit"
    )
    s["service_costing_by_level"] = _select(
        """SELECT service_level, mode_dsc, count(*) AS n_rows, count(*) FILTER (shipping_cost IS NULL) AS n_uncosted,
                  sum(shipping_cost) AS total_cost FROM costed GROUP BY ALL""",
        "service_level, mode_dsc, n_rows, n_uncosted",
        "total_cost",
    )

    def required(purpose: str, columns: str, lacking: str, source: str) -> list[str]:
        return [
            _check(f"required for {purpose}", "ERROR", c, "count(*)", source, "'column is not there'")
            if c in lacking.split()
            else _check(f"required for {purpose}", "ERROR", c, "0", f"(SELECT 1 FROM {source} LIMIT 1)")
            for c in columns.split()
        ]

    needed = "carrier origin_port destination_port service_level weight"
    card = "orig_port_cd dest_port_cd svc_cd minm_wgh_qty max_wgh_qty rate"
    levels = "order_id service_level weight carrier origin_port destination_port shipping_cost"
    s["check_required_columns_seeded"] = _select(
        " UNION ALL ".join(
            required("shipping costs", needed, "weight", "order_list")
            + required("shipping costs", card, "rate svc_cd", "freight_rates")
            + required("service levels", levels, "shipping_cost", "first_costed")
        ),
        CHECK_KEYS,
    )

    def structure(frame: str, lost: str, text: str, empty: bool) -> list[str]:
        source = "shipping" if frame == "broken" else "(SELECT 1)"
        rows = [
            _check("required for grouping", "ERROR", c, *(("count(*)", source, "'column is not there'") if c == lost else ("0", "(SELECT 1)")))
            for c in ("origin_port", "destination_port", "carrier")
        ]
        rows += [
            _check("not numeric", "ERROR", c, *(("count(*)", source, "'measure must be numeric'") if c == text else ("0", "(SELECT 1)")))
            for c in ("total_weight", "total_shipping_cost")
        ]
        rows.append(_check("no rows", "ERROR", "*", *(("1", "(SELECT 1)", "'there is no row'") if empty else ("0", "(SELECT 1)"))))
        return [f"SELECT '{frame}' AS frame, * FROM ({r})" for r in rows]

    s["check_structure_seeded"] = _select(
        " UNION ALL ".join(
            structure("whole", "", "", False)
            + structure("broken", "carrier", "total_weight", False)
            + structure("empty", "", "", True)
        ),
        f"frame, {CHECK_KEYS}",
    )

    def sizes(shown: str, plants: str, served: str, levels: str) -> str:
        rows = (
            ("routes_data", "", "origin_port, destination_port, carrier, mode_dsc, total_shipping_cost, n_orders",
             f"(SELECT DISTINCT origin_port, destination_port, carrier, mode_dsc FROM shipping {shown})"),
            ("storage_costs", "", "plant_code, storage_cost, total_units, cost_per_unit", f"costs {served}"),
            ("transport_mode", "", "mode_dsc, total_cost, total_orders, total_weight, avg_cost_per_order",
             f"(SELECT DISTINCT mode_dsc FROM shipping {shown})"),
            ("service_level", "", "service_level, n, percentage", f"(SELECT DISTINCT service_level FROM order_list {levels})"),
            ("cost_breakdown", "_070809", "origin_port, transport_cost, storage_cost, total_cost, pct_transport, pct_storage",
             f"(SELECT DISTINCT origin_port FROM shipping {shown})"),
            ("unit_cost_analysis", "_070809", "plant_code, cost_per_unit, cost_per_kg, total_units, total_orders, quadrant", f"costs {plants}"),
            ("efficiency_matrix", "_070809", "plant_code, storage_efficiency, unit_cost_efficiency, kg_cost_efficiency, volume_efficiency",
             f"costs {plants}"),
        )
        return " UNION ALL ".join(
            f"SELECT '{name}' AS name, '{name}_20240105{time}.csv' AS file, '{columns}' AS columns, count(*) AS n_rows FROM {source}"
            for name, time, columns, source in rows
        )

    s["filter_exports"] = _select(sizes("", "", "", ""), "name, file, columns, n_rows")
    one = "plant_code = 'PLANT03'"
    s["filter_exports_of_plant"] = _select(
        sizes(
            "WHERE origin_port = 'PORT03' AND carrier = 'V44_1'",
            f"WHERE {one}",
            f"WHERE {one} AND {_BY_CARRIER.format('V44_1')}",
            f"WHERE {one} AND carrier = 'V44_1'",
        ),
        "name, file, columns, n_rows",
    )

    def orders(share: str, count: str) -> str:
        whole = f"CAST(CAST(round_even(round({share}, 6), 0) AS BIGINT) AS VARCHAR)"
        return f"{whole} || '%' || chr(10) || {_COMMA.format(count)} || ' orders'"

    def heavy(text: str) -> str:
        return f"CASE WHEN total_weight > 1000 THEN {text} WHEN total_weight <= 1000 THEN '' END"

    def kilos(digits: int) -> str:
        return _COMMA.format(f"round_even(round(total_weight, 6), {digits})") + " || ' kg'"

    texts = {
        "service_mix_labels": ("weight_band_service_mix", "label", orders("pct_orders", "total_orders")),
        "carrier_service_labels": ("carrier_service", "label", orders("pct_carrier_orders", "orders")),
        "service_labels": (
            "service_summary",
            "label",
            f"{_percent_text('pct_orders')} || chr(10) || {_COMMA.format('orders')} || ' orders'",
        ),
        "band_route_labels": (
            "weight_band_routes",
            "label",
            heavy(f"{kilos(-1)} || chr(10) || {_COMMA.format('total_orders')} || ' orders'"),
        ),
        "route_service_labels": (
            "route_service",
            "label_text",
            heavy(f"{kilos(0)} || chr(10) || '(' || {_COMMA.format('orders')} || ' orders)'"),
        ),
        "service_cost_labels": (
            "service_cost_efficiency",
            "label",
            f"'$' || {_NUM.format('round_even(round(avg_cost_per_kg, 6), 2)')} || '/kg' || chr(10) || "
            f"{kilos(0)} || ' total'",
        ),
    }
    for name, (base, label, text) in texts.items():
        s[name] = f"SELECT *, {text} AS {label} FROM ({s[base]})"
    s["storage_labels"] = f"""
        SELECT *, {_dollar_auto('storage_cost')} AS cost_label,
               {_COMMA.format('round_even(round(total_units, 6), 0)')} AS units_label,
               {_DOLLAR.format('cost_per_unit')} AS efficiency_label
        FROM ({s['storage_ranking_of_all']})"""
    s["warehouse_duplicates"] = _select(_duplicates("wh", "wh_costs"), CHECK_KEYS)
    return s
