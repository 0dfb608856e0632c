"""SQL for DuckDB that states the result of each registered query from the given tables.

Money is summed as DECIMAL and converted once. Rounded quotients are computed in integers
(``half_up``), since a rounded DOUBLE depends on the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from checks.catalog import (
    NARROW, NARROW_REPORTS, ORDER_REPORTS, ROLLED_ORDER_REPORTS, ROLLED_SELECTED_REPORTS, SELECTED_REPORTS,
)
from checks.workspace import COPY_OFFSET

# Fixed values, stated here again so that a wrong one in the library shows: columns, texts for "no value", labels.
BASE = (
    "row_id", "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name", "segment", "country",
    "city", "state", "postal_code", "region", "product_id", "category", "sub_category", "product_name", "sales", "quantity",
    "discount", "profit",
)
DERIVED = (
    "profit_margin", "order_year", "order_month", "order_month_name", "order_quarter", "revenue_per_unit",
    "discount_percentage", "discount_band", "shipping_days", "weekend_flag", "profitability_flag",
)
EXPECTED_COLUMNS = BASE + DERIVED
NUMBERS = ("postal_code", "sales", "quantity", "discount", "profit")
TRIMMED = (
    "ship_mode", "customer_name", "segment", "country", "city", "state", "region", "category", "sub_category", "product_name",
)
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
CHAMPIONS = "Champions (Highly Active & Loyal)"
LOYAL = "Loyal Customers (Regular Buyers)"
AT_RISK = "At Risk (Frequent Buyers, Slipping)"
LOST = "Hibernating / Lost"
NEW = "New / Promising Customers"


def half_up(part: str, whole: str, digits: int) -> str:
    """part / whole for DECIMALs of up to four places, rounded half away from zero, as DOUBLE."""
    p, w = (f"CAST(({x}) * 10000 AS HUGEINT)" for x in (part, whole))
    size = f"((2 * abs({p}) * {10**digits} + abs({w})) // (2 * abs({w})))"
    sign = f"(CASE WHEN ({p} < 0) <> ({w} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {w} = 0 THEN NULL ELSE CAST({sign} * {size} AS DOUBLE) / {10**digits}.0 END)"


def half_even(value: str, digits: int) -> str:
    y = f"(({value}) * {float(10**digits)})"
    tie = f"({y} - floor({y}) = 0.5)"
    return f"((CASE WHEN {tie} THEN round({y} / 2) * 2 ELSE round({y}) END) / {float(10**digits)})"


def percent(part: str, whole: str) -> str:
    p, w = f"CAST({part} AS DOUBLE)", f"nullif(CAST({whole} AS DOUBLE), 0)"
    return half_even(f"{p} / {w} * 100", 2)


LINES = """
items AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_extendedprice, l_quantity, l_discount) AS row_id
  FROM lineitem
), lines AS (
  SELECT row_id,
    'O-' || o_orderkey AS order_id,
    CAST(o_orderdate AS DATE) AS order_date,
    CAST(o_orderdate AS DATE) + CAST(
      ((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 11) + 11) % 11
      - 1 + (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) AS INTEGER) AS ship_date,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Same Day' WHEN '2' THEN 'First Class'
      WHEN '3' THEN 'Second Class' ELSE 'Standard Class' END AS ship_mode,
    'C-' || c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
    n_name AS country, CAST(NULL AS VARCHAR) AS city, n_name AS state, CAST(NULL AS BIGINT) AS postal_code,
    r_name AS region, 'P-' || p_partkey AS product_id, p_type AS category, p_brand AS sub_category,
    p_name AS product_name,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(28,4)) AS sales,
    CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
    CAST(CAST(l_discount AS DECIMAL(5,2)) * 4 AS DECIMAL(9,4)) AS discount,
    CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - 4 * CAST(l_discount AS DECIMAL(5,2)))
      - CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.5 AS DECIMAL(2,1))
      AS DECIMAL(12,2)) AS DECIMAL(28,4)) AS profit
  FROM items
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""

RAW = f"""
originals AS (
  SELECT CAST(row_id AS VARCHAR) AS row_id, order_id,
    CASE WHEN row_id % 127 = 0 THEN '13/45/1999'
      ELSE month(order_date) || '/' || day(order_date) || '/' || year(order_date) END AS order_date,
    CASE WHEN row_id % 131 <> 0
      THEN month(ship_date) || '/' || day(ship_date) || '/' || year(ship_date) END AS ship_date,
    ship_mode, customer_id, customer_name,
    CASE WHEN row_id % 7 = 0 THEN '  ' || segment || ' ' ELSE segment END AS segment,
    country, city, state, CAST(postal_code AS VARCHAR) AS postal_code,
    CASE WHEN row_id % 137 = 0 THEN 'NA' ELSE region END AS region,
    product_id, category, sub_category, product_name,
    CASE WHEN row_id % 101 = 0 THEN 'abc' WHEN row_id % 103 = 0 THEN '-' || sales
      WHEN row_id % 107 <> 0 THEN CAST(sales AS VARCHAR) END AS sales,
    CASE WHEN row_id % 109 = 0 THEN '0' ELSE CAST(quantity AS VARCHAR) END AS quantity,
    CASE WHEN row_id % 113 = 0 THEN '1.5' ELSE CAST(discount AS VARCHAR) END AS discount,
    CASE WHEN row_id % 139 = 0 THEN 'n/a' ELSE CAST(profit AS VARCHAR) END AS profit
  FROM lines
), raw AS (
  SELECT * FROM originals
  UNION ALL
  SELECT * REPLACE (CAST(CAST(row_id AS BIGINT) + {COPY_OFFSET} AS VARCHAR) AS row_id)
  FROM originals WHERE CAST(row_id AS BIGINT) % 50 = 0
)"""

_TOKENS = ", ".join(f"'{t}'" for t in NO_VALUE)
_NULLED = ", ".join(f"CASE WHEN {c} NOT IN ({_TOKENS}) THEN {c} END AS {c}" for c in BASE)
_NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
_SQL_TYPES = {
    "sales": "DECIMAL(28,4)", "quantity": "DECIMAL(18,4)", "discount": "DECIMAL(9,4)", "profit": "DECIMAL(28,4)",
    "postal_code": "BIGINT", "row_id": "BIGINT",
}


def _standard(name: str) -> str:
    if name in _SQL_TYPES:
        value = f"CASE WHEN regexp_matches({name}, {_NUMBER}) THEN TRY_CAST({name} AS {_SQL_TYPES[name]}) END"
    elif name in ("order_date", "ship_date"):
        value = f"CAST(try_strptime({name}, '%m/%d/%Y') AS DATE)"
    elif name in TRIMMED:
        value = f"trim({name})"
    else:
        value = name
    return f"{value} AS {name}"


_CONTENT = ", ".join(c for c in BASE if c != "row_id")
CLEAN = f"""
nulled AS (SELECT {_NULLED} FROM raw),
standard AS (SELECT {", ".join(_standard(c) for c in BASE)} FROM nulled),
folded AS (SELECT min(row_id) AS row_id, {_CONTENT}, count(*) AS copies FROM standard GROUP BY {_CONTENT}),
cleaned AS (SELECT * EXCLUDE (copies) FROM folded)"""

_DOUBLE_MARGIN = "CAST(profit AS DOUBLE) / nullif(CAST(sales AS DOUBLE), 0)"
FEATURE_SQL = {
    "profit_margin": f"CASE WHEN {_DOUBLE_MARGIN} < 0 THEN 0 WHEN {_DOUBLE_MARGIN} > 1 THEN 1 ELSE {_DOUBLE_MARGIN} END",
    "order_year": "CAST(year(order_date) AS INTEGER)",
    "order_month": "CAST(month(order_date) AS INTEGER)",
    "order_month_name": "monthname(order_date)",
    "order_quarter": "CAST(quarter(order_date) AS INTEGER)",
    "revenue_per_unit": "CAST(sales AS DOUBLE) / nullif(CAST(quantity AS DOUBLE), 0)",
    "discount_percentage": "discount * 100",
    "discount_band": """CASE WHEN discount < -0.01 THEN NULL WHEN discount <= 0.1 THEN 'low' WHEN discount <= 0.2 THEN 'medium'
      WHEN discount <= 0.3 THEN 'high' WHEN discount <= 1.0 THEN 'very_high' END""",
    "shipping_days": """CASE WHEN ship_date IS NULL OR order_date IS NULL THEN NULL
      WHEN ship_date < order_date THEN 0 ELSE CAST(ship_date - order_date AS INTEGER) END""",
    "weekend_flag": "coalesce(dayofweek(order_date) IN (0, 6), false)",
    "profitability_flag": "coalesce(profit > 0, false)",
}
CLEANING_FEATURES = (
    "shipping_days", "profit_margin", "order_year", "order_month", "order_month_name", "order_quarter", "weekend_flag",
)


def _typed(double: str, dtype: str) -> str:
    """A DOUBLE stored in a DECIMAL column: its shortest decimal text, rounded half up."""
    return f"CAST(CAST({double} AS VARCHAR) AS {dtype})"


_WAREHOUSE_SQL = FEATURE_SQL | {
    "postal_code": "CAST(postal_code AS INTEGER)",
    "sales": "CAST(sales AS DECIMAL(12,2))",
    "quantity": "CAST(quantity AS INTEGER)",
    "discount": "CAST(discount AS DECIMAL(5,2))",
    "profit": "CAST(profit AS DECIMAL(12,2))",
    "profit_margin": _typed(FEATURE_SQL["profit_margin"], "DECIMAL(6,4)"),
    "revenue_per_unit": _typed(FEATURE_SQL["revenue_per_unit"], "DECIMAL(12,2)"),
    "discount_percentage": "CAST(discount * 100 AS DECIMAL(6,2))",
}


def _all_columns(expressions: dict[str, str], names=EXPECTED_COLUMNS) -> str:
    return ", ".join(f"{expressions[c]} AS {c}" if c in expressions else c for c in names)


WAREHOUSE = f"retail AS (SELECT {_all_columns(_WAREHOUSE_SQL)} FROM lines)"
REFRESHED = f"retail AS (SELECT {_all_columns(_WAREHOUSE_SQL)} FROM cleaned)"
ENRICHED = f"enriched AS (SELECT {_all_columns(FEATURE_SQL)} FROM lines)"
ENRICHED_RAW = f"enriched AS (SELECT {_all_columns(FEATURE_SQL)} FROM cleaned)"

_MONEY = {"sales", "discount", "profit", "profit_margin", "revenue_per_unit", "discount_percentage"}
_DATES = {"order_date", "ship_date"}


def _portable(names, source: str) -> str:
    def column(name: str) -> str:
        if name in _MONEY or (name == "quantity" and not source.startswith("retail")):  # an integer in the warehouse only
            return f"CAST({name} AS DOUBLE) AS {name}"
        return f"CAST({name} AS VARCHAR) AS {name}" if name in _DATES else name

    return f"SELECT {', '.join(column(c) for c in names)} FROM {source}"


def _with(*parts: str) -> Callable[[str], str]:
    return lambda query: "WITH " + ", ".join(p.strip() for p in parts) + "\n" + query


on_lines = _with(LINES)
on_raw = _with(LINES, RAW)
on_clean = _with(LINES, RAW, CLEAN)
on_enriched = _with(LINES, ENRICHED)
on_enriched_raw = _with(LINES, RAW, CLEAN, ENRICHED_RAW)
on_warehouse = _with(LINES, WAREHOUSE)
on_refreshed = _with(LINES, RAW, CLEAN, REFRESHED)


def _members(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_NARROW_MEMBERS = " AND ".join(
    [_members("region", NARROW.regions), _members("segment", NARROW.segments), _members("category", NARROW.categories)]
)
_NARROW_DATES = f"order_date BETWEEN DATE '{NARROW.start}' AND DATE '{NARROW.end}'"
_ALL_OPTIONS = "region IS NOT NULL AND segment IS NOT NULL AND category IS NOT NULL AND order_date IS NOT NULL"


def _selected(where: str) -> str:
    return f"selected AS (SELECT * FROM retail WHERE {where})"


# ---- reports ----------------------------------------------------------------------------------

S, P = "CAST(sum(sales) AS DOUBLE)", "CAST(sum(profit) AS DOUBLE)"
O = "count(DISTINCT order_id)"
M = half_up("sum(profit)", "sum(sales)", 4)
S0, P0 = "CAST(coalesce(sum(sales), 0) AS DOUBLE)", "CAST(coalesce(sum(profit), 0) AS DOUBLE)"
U0 = "CAST(coalesce(sum(quantity), 0) AS BIGINT)"
PCT = percent("coalesce(sum(profit), 0)", "coalesce(sum(sales), 0)")
CORE = f"{O} AS total_orders, {S} AS total_sales, {P} AS total_profit, {M} AS profit_margin"

_DETAIL = """order_id, CAST(order_date AS VARCHAR) AS order_date, customer_id, customer_name, segment, region, category,
  sub_category, ship_mode, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, quantity,
  CAST(discount AS DOUBLE) AS discount, CAST(profit_margin AS DOUBLE) AS profit_margin, shipping_days,
  weekend_flag, profitability_flag"""
_RUNNING = "ORDER BY order_year NULLS LAST, order_month NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_FOUR = "ORDER BY order_year NULLS LAST, order_month NULLS LAST ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"
_PRODUCT = "product_id, product_name, category, sub_category"


def _ranked(keys: str, metric: str, name: str) -> str:
    return f"""SELECT {keys}, {CORE}, rank() OVER (ORDER BY {metric} DESC NULLS FIRST) AS {name}
FROM retail GROUP BY {keys}"""


_PRODUCT_PROFIT = f"SELECT {_PRODUCT}, {S} AS total_sales, {P} AS total_profit, {M} AS profit_margin FROM retail GROUP BY {_PRODUCT}"

ORDER_SQL = {
    "vw_sales_summary": f"""SELECT {_DETAIL}, (SELECT {S} FROM retail) AS total_sales_all_rows,
  (SELECT {P} FROM retail) AS total_profit_all_rows FROM retail""",
    "vw_monthly_sales": f"""SELECT order_year, order_month, order_month_name, CAST(s AS DOUBLE) AS total_sales,
  CAST(p AS DOUBLE) AS total_profit, o AS total_orders,
  CAST(sum(s) OVER ({_RUNNING}) AS DOUBLE) AS running_sales,
  {half_up(f"sum(s) OVER ({_FOUR})", f"CAST(count(s) OVER ({_FOUR}) AS DECIMAL(18,0))", 6)} AS moving_avg_sales
FROM (SELECT order_year, order_month, order_month_name, sum(sales) AS s, sum(profit) AS p, {O} AS o
  FROM retail GROUP BY ALL)""",
    "vw_region_performance": _ranked("region", "sum(sales)", "sales_rank"),
    "vw_category_performance": _ranked("category", "sum(profit)", "profit_rank"),
    "vw_customer_summary": _ranked("customer_id, customer_name, segment, region", "sum(sales)", "sales_rank"),
    "vw_product_performance": _ranked(_PRODUCT, "sum(profit)", "profit_rank"),
    "vw_shipping_analysis": f"""SELECT ship_mode, {CORE}, avg(shipping_days) AS avg_shipping_days,
  CASE WHEN ship_mode IN ('First Class', 'Same Day') THEN 'Priority' ELSE 'Standard' END AS shipping_group
FROM retail GROUP BY ship_mode""",
    "executive_kpis": f"""SELECT {S} AS total_revenue, {P} AS total_profit, {O} AS total_orders, {M} AS profit_margin,
  {half_up("sum(sales)", f"CAST({O} AS DECIMAL(18,0))", 2)} AS avg_order_value FROM retail""",
    "monthly_running": f"""SELECT order_year, order_month, order_month_name, CAST(s AS DOUBLE) AS monthly_sales,
  CAST(p AS DOUBLE) AS monthly_profit, CAST(sum(s) OVER ({_RUNNING}) AS DOUBLE) AS running_sales
FROM (SELECT order_year, order_month, order_month_name, sum(sales) AS s, sum(profit) AS p FROM retail GROUP BY ALL)""",
    "region_category": f"""SELECT region, category, {S} AS total_sales, {P} AS total_profit, {M} AS profit_margin
FROM retail GROUP BY region, category""",
    "segment_customer_rank": f"""SELECT segment, customer_name, {S} AS total_sales, {P} AS total_profit,
  rank() OVER (PARTITION BY segment ORDER BY sum(sales) DESC NULLS FIRST) AS customer_rank
FROM retail GROUP BY segment, customer_name""",
    "product_double_rank": f"""SELECT product_name, category, sub_category, {S} AS total_sales, {P} AS total_profit,
  rank() OVER (ORDER BY sum(sales) DESC NULLS FIRST) AS sales_rank,
  rank() OVER (ORDER BY sum(profit) DESC NULLS FIRST) AS profit_rank
FROM retail GROUP BY product_name, category, sub_category""",
    "shipping_efficiency": f"""SELECT ship_mode, {O} AS total_orders, {S} AS total_sales,
  avg(shipping_days) AS avg_shipping_days,
  CASE WHEN avg(shipping_days) > 5 THEN 'Slow' ELSE 'Efficient' END AS shipping_efficiency
FROM retail GROUP BY ship_mode""",
    "discount_impact": f"SELECT discount_band, {CORE} FROM retail GROUP BY discount_band",
    "top10_customers_by_sales": f"""SELECT customer_name, {S} AS total_sales FROM retail GROUP BY customer_name
ORDER BY sum(sales) DESC NULLS FIRST, customer_name NULLS LAST LIMIT 10""",
    "eda_monthly_by_name": f"""SELECT order_year, order_month_name, {S0} AS sales FROM retail
WHERE order_year IS NOT NULL AND order_month_name IS NOT NULL GROUP BY order_year, order_month_name""",
    "eda_region": f"""SELECT region, {S0} AS total_sales, {P0} AS total_profit, {O} AS order_count
FROM retail WHERE region IS NOT NULL GROUP BY region""",
    "eda_category": f"""SELECT category, {S0} AS total_sales, {P0} AS total_profit
FROM retail WHERE category IS NOT NULL GROUP BY category""",
    "top15_products": f"""{_PRODUCT_PROFIT} ORDER BY sum(profit) DESC NULLS LAST, product_id NULLS LAST,
  product_name NULLS LAST, category NULLS LAST, sub_category NULLS LAST LIMIT 15""",
    "loss_makers": f"{_PRODUCT_PROFIT} HAVING sum(profit) < 0",
}

_MONTHS = f"""SELECT order_year, order_month, order_month_name, coalesce(sum(sales), 0) AS r, coalesce(sum(profit), 0) AS p
  FROM selected WHERE order_month_name IS NOT NULL GROUP BY order_year, order_month, order_month_name"""
_MONTH_COLUMNS = """order_year, order_month, order_month_name, CAST(r AS DOUBLE) AS revenue, CAST(p AS DOUBLE) AS profit,
  order_month_name || ' ' || order_year AS month_year"""
_BY_MONTH = "ORDER BY order_year, order_month"


def _dash(keys: str, metrics: str) -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"SELECT {keys}, {metrics} FROM selected WHERE {present} GROUP BY {keys}"


_PAIRS = """SELECT a.sub_category AS item_a, b.sub_category AS item_b, count(*) AS order_count,
    min(a.order_id) AS first_order
  FROM (SELECT DISTINCT order_id, sub_category FROM selected) a
  JOIN (SELECT DISTINCT order_id, sub_category FROM selected) b
    ON a.order_id = b.order_id AND a.sub_category < b.sub_category
  GROUP BY a.sub_category, b.sub_category"""

_CUSTOMER = "customer_id, customer_name, segment"
_RFM_BASE = f"""SELECT {_CUSTOMER},
    CAST((SELECT max(order_date) FROM selected) - max(order_date) AS INTEGER) AS recency,
    {O} AS frequency, coalesce(sum(sales), 0) AS monetary
  FROM selected WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL AND segment IS NOT NULL
  GROUP BY {_CUSTOMER}"""


def _bin(metric: str) -> str:
    r = f"row_number() OVER (ORDER BY {metric}, {_CUSTOMER})"
    n = "count(*) OVER ()"
    return f"CAST(CASE WHEN {n} = 1 THEN 1 ELSE greatest(1, (5 * ({r} - 1) + ({n} - 2)) // ({n} - 1)) END AS INTEGER)"


_RFM_SCORES = f"""SELECT {_CUSTOMER}, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
    6 - {_bin("recency")} AS r_score, {_bin("frequency")} AS f_score, {_bin("monetary")} AS m_score
  FROM ({_RFM_BASE})"""
_RFM = f"""SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN '{CHAMPIONS}'
    WHEN f_score >= 3 AND m_score >= 3 THEN '{LOYAL}' WHEN r_score <= 2 AND f_score >= 3 THEN '{AT_RISK}'
    WHEN r_score <= 2 THEN '{LOST}' ELSE '{NEW}' END AS rfm_segment
  FROM ({_RFM_SCORES})"""

def _coefficient(x: str, y: str) -> str:
    def spread(a: str, b: str) -> str:
        s = [f"sum(CAST({v} AS HUGEINT))" for v in (a, b)]
        return f"CAST(count(*) * sum(CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) - {s[0]} * {s[1]} AS DOUBLE)"

    alone = f"(sqrt({spread(x, x)}) * sqrt({spread(y, y)}))"
    return half_even(f"{spread(x, y)} / nullif({alone}, 0)", 9)


_CORRELATION = f"""SELECT count(*) AS lines, {_coefficient("x", "y")} AS pearson, {_coefficient("place_x", "place_y")} AS spearman FROM (
  SELECT x, y, 2 * rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) AS place_x, 2 * rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) AS place_y
  FROM (SELECT CAST(CAST(discount_percentage AS DECIMAL(9,4)) * 10000 AS BIGINT) AS x, CAST(CAST(profit_margin AS DECIMAL(9,4)) * 10000 AS BIGINT) AS y
    FROM selected WHERE discount_percentage IS NOT NULL AND profit_margin IS NOT NULL))"""

SELECTED_SQL = {
    "dash_kpis": f"""SELECT s AS total_sales, p AS total_profit, o AS total_orders,
  CASE WHEN s > 0 THEN p / s * 100 ELSE 0 END AS gross_margin, CASE WHEN o > 0 THEN s / o ELSE 0 END AS avg_order_value
FROM (SELECT {S0} AS s, {P0} AS p, {O} AS o FROM selected)""",
    "dash_monthly": f"SELECT {_MONTH_COLUMNS} FROM ({_MONTHS})",
    "month_label": f"SELECT order_year, order_month, order_month_name || ' ' || order_year AS month_year FROM ({_MONTHS})",
    "dash_cumulative": f"""SELECT {_MONTH_COLUMNS}, CAST(sum(r) OVER ({_BY_MONTH}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_sales FROM ({_MONTHS})""",
    "dash_region": _dash("region", f'{S0} AS revenue, {P0} AS profit, {O} AS orders, {U0} AS qty_sold, {PCT} AS "margin_%"'),
    "dash_segment_revenue": _dash("segment", f"{S0} AS revenue"),
    "dash_category_revenue": _dash("category", f"{S0} AS revenue"),
    "dash_segment_category": _dash(
        "segment, category, sub_category", f'{S0} AS revenue, {P0} AS profit, {U0} AS qty_sold, {PCT} AS "margin_%"'
    ),
    "dash_discount_band": _dash("discount_band", f"{S0} AS revenue, {P0} AS profit"),
    "dash_subcategory": _dash("sub_category", f"{S0} AS sales"),
    "dash_top10_profit_customers": _dash(
        "customer_name, segment, region", f'{S0} AS revenue, {P0} AS profit, {O} AS orders, {PCT} AS "margin_%"'
    )
    + " ORDER BY coalesce(sum(profit), 0) DESC, customer_name, segment, region LIMIT 10",
    "dash_ship_days_by_mode": _dash("ship_mode", "avg(shipping_days) AS avg_shipping_days"),
    "dash_ship_days_by_region": _dash("region", "avg(shipping_days) AS avg_shipping_days"),
    "dash_weekend": f"""SELECT CASE WHEN weekend_flag THEN 'Weekend Order' ELSE 'Weekday Order' END AS order_day_type,
  {O} AS total_orders, avg(shipping_days) AS avg_transit_days, {S0} AS total_revenue, {P0} AS total_profit
FROM selected GROUP BY weekend_flag""",
    "mom_growth": f"""SELECT {_MONTH_COLUMNS}, CASE WHEN before IS NULL OR (before = 0 AND r = 0) THEN 0
  ELSE {half_even("(CAST(r AS DOUBLE) / nullif(before, 0) - 1) * 100", 2)} END AS "mom_growth_%"
FROM (SELECT *, CAST(lag(r) OVER ({_BY_MONTH}) AS DOUBLE) AS before FROM ({_MONTHS}))""",
    "discount_margin_curve": f"""SELECT CAST(discount_percentage AS DOUBLE) AS discount_percentage,
  CAST(sum(CAST(profit_margin AS DECIMAL(6,4))) AS DOUBLE) / nullif(count(profit_margin), 0) AS avg_margin, {O} AS orders
FROM selected WHERE discount_percentage IS NOT NULL GROUP BY selected.discount_percentage""",
    "discount_margin_correlation": _CORRELATION,
    "basket_pairs": f"""SELECT item_a || ' & ' || item_b AS sub_category_pair, order_count AS frequency
FROM ({_PAIRS}) ORDER BY order_count DESC, first_order, item_a, item_b LIMIT 15""",
    "basket_pairs_all": _PAIRS,
    "rfm_base": f"SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM ({_RFM_BASE})",
    "rfm_scores": _RFM_SCORES,
    "rfm_segment": _RFM,
    "rfm_distribution": f"SELECT rfm_segment, count(*) AS customer_count FROM ({_RFM}) GROUP BY rfm_segment",
    "rfm_financials": f"""SELECT rfm_segment, count(*) AS total_customers, avg(recency) AS avg_recency,
  avg(frequency) AS avg_frequency, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
FROM ({_RFM}) GROUP BY rfm_segment""",
    "rfm_detail": f"SELECT {_CUSTOMER}, recency, frequency, monetary, rfm_segment FROM ({_RFM})",
    "state_performance": _dash(
        "state", f'{S0} AS revenue, {P0} AS profit, {O} AS orders, {U0} AS qty_sold, {PCT} AS "margin_%"'
    ),
    "segment_share": _dash(
        "segment",
        f"""{S0} AS revenue, {P0} AS profit,
  {percent("coalesce(sum(sales), 0)", "(SELECT sum(sales) FROM selected)")} AS "share_%", {PCT} AS "margin_%" """,
    ),
    "shipping_distribution": _dash("ship_mode", f"count(*) AS shipments, {O} AS orders"),
}

# ---- sources, cleaning, features, filters ---------------------------------------------------------

_INVALID = {
    "invalid_sales": "sales IS NULL OR sales < 0",
    "invalid_quantity": "quantity IS NULL OR quantity < 1",
    "invalid_discount": "discount IS NULL OR discount < 0 OR discount > 1",
    "invalid_dates": "order_date IS NULL OR ship_date IS NULL",
}
_COUNTS = {
    "source_rows": "CAST(sum(copies) AS BIGINT)",
    "rows_after_cleaning": "count(*)",
    "duplicate_rows": "CAST(sum(copies) - count(*) AS BIGINT)",
    **{name: f"count(*) FILTER ({rule})" for name, rule in _INVALID.items()},
}


def _report(*names: str) -> str:
    return on_clean(f"SELECT {', '.join(f'{_COUNTS[n]} AS {n}' for n in names)} FROM folded")


def _missing(value: str, name: str, where: str) -> str:
    rows = [
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, count(*) AS n FROM folded" for c in BASE
    ]
    return on_clean(f"SELECT column_name, {value} AS {name} FROM ({' UNION ALL '.join(rows)}) WHERE {where}")


def _enriched(names=EXPECTED_COLUMNS) -> str:
    return on_enriched_raw(_portable(names, "enriched"))


def _options() -> str:
    return " UNION ".join(
        f"SELECT '{c}' AS filter, {c} AS value FROM retail WHERE {c} IS NOT NULL"
        for c in ("region", "segment", "category")
    )


def _view_counts() -> str:
    keys = {
        "vw_monthly_sales": "order_year, order_month, order_month_name",
        "vw_region_performance": "region",
        "vw_category_performance": "category",
        "vw_customer_summary": "customer_id, customer_name, segment, region",
        "vw_product_performance": _PRODUCT,
        "vw_shipping_analysis": "ship_mode",
    }
    counts = [f"SELECT '{v}' AS view_name, count(*) AS row_count FROM (SELECT DISTINCT {k} FROM retail)" for v, k in keys.items()]
    return " UNION ALL ".join(["SELECT 'vw_sales_summary' AS view_name, count(*) AS row_count FROM retail", *counts])


_BROKEN = f"(SELECT row_id % {COPY_OFFSET} AS row_id, CASE WHEN region IS NOT NULL THEN order_id END AS order_id FROM standard)"
_LOADED = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c in _DATES else f"CAST({c} AS DOUBLE) AS {c}" if c in {*_MONEY, "quantity"} else c
    for c in EXPECTED_COLUMNS
)

_NUMBER_OF_LINE = f"CAST(row_id AS BIGINT) % {COPY_OFFSET}"
_SHORT = f"{_NUMBER_OF_LINE} % 151 = 0"
_SURPLUS = f"{_NUMBER_OF_LINE} % 157 = 0 AND {_NUMBER_OF_LINE} % 151 <> 0"
_SALVAGED = [f"CASE WHEN NOT ({_SHORT}) THEN {c} END AS {c}" if c in BASE[-2:] else c for c in BASE]

OTHER_SQL = {
    "scan_raw_csv": on_raw("SELECT * FROM raw"),
    "null_tokens": _with(LINES, RAW, CLEAN)("SELECT * FROM nulled"),
    "normalize_headers": on_raw("SELECT sub_category, postal_code, row_id FROM raw"),
    "write_processed": _enriched(),
    "scan_processed": _enriched(),
    "load_warehouse": on_refreshed(_portable(EXPECTED_COLUMNS, "retail")),
    "warehouse_schema": on_warehouse(_portable(EXPECTED_COLUMNS, "retail")),
    "scan_warehouse": on_warehouse(_portable(EXPECTED_COLUMNS, "retail")),
    "resolve_source": _enriched(),
    "table_stats": on_warehouse(
        """SELECT count(*) AS row_count, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT product_id) AS unique_products FROM retail"""
    ),
    "align_schema": on_warehouse(_portable(EXPECTED_COLUMNS, "retail")),
    "prepare_for_load": on_enriched_raw(f"SELECT {_LOADED} FROM enriched"),
    "register_views": on_warehouse(_view_counts()),
    "key_checks": on_clean(
        f"""SELECT v.rule AS "check", row_id, v.n AS rows FROM (
  SELECT row_id, unnest([{{'rule': 'row_id repeats', 'n': CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END}},
    {{'rule': 'order_id is null', 'n': count(*) FILTER (order_id IS NULL)}}]) AS v
  FROM {_BROKEN} GROUP BY row_id) WHERE v.n > 0"""
    ),
    "salvage_raw_lines": on_raw(f"SELECT {', '.join(_SALVAGED)} FROM raw WHERE NOT ({_SURPLUS})"),
    "salvage_rejected_lines": on_raw(f"SELECT row_id FROM raw WHERE {_SURPLUS}"),
    "salvage_counts": on_raw(f"""SELECT count(*) AS lines_read, count(*) FILTER ({_SHORT}) AS lines_padded,
  count(*) FILTER ({_SURPLUS}) AS lines_rejected FROM raw"""),
    "append_arrivals": on_refreshed(_portable([c for c in EXPECTED_COLUMNS if c != "row_id"], "retail")),
    "date_formats": on_clean(f"""SELECT export, column_name, CASE export WHEN '0' THEN 'M/d/yyyy' WHEN '1' THEN 'd.M.yyyy' ELSE 'yyyy-M-d' END AS format,
  count(date) AS parsed, count(text) AS filled FROM (
  SELECT CAST(row_id % 3 AS VARCHAR) AS export, unnest(['order_date', 'ship_date']) AS column_name,
    unnest([s.order_date, s.ship_date]) AS date, unnest([n.order_date, n.ship_date]) AS text
  FROM standard s JOIN (SELECT CAST(row_id AS BIGINT) AS row_id, order_date, ship_date FROM nulled) n USING (row_id)) GROUP BY export, column_name"""),
    "parse_mixed_dates": on_clean("SELECT CAST(row_id AS VARCHAR) AS row_id, CAST(order_date AS VARCHAR) AS order_date, CAST(ship_date AS VARCHAR) AS ship_date FROM standard"),
    "coerce_numeric": on_clean(_portable(("row_id", *NUMBERS), "standard")),
    "coerce_dates": on_clean(_portable(("row_id", "order_date", "ship_date"), "standard")),
    "trim_text": on_clean(_portable(("row_id", *TRIMMED), "standard")),
    "dedup_ignoring_row_id": on_clean(_portable(BASE, "cleaned")),
    "dedup_by_digest": on_clean(_portable(BASE, "cleaned")),
    "duplicate_rows": _report("duplicate_rows"),
    "missing_values": _missing("missing", "missing", "true"),
    "missing_percent": _missing("CAST(printf('%.2f', missing / n * 100) AS DOUBLE)", "missing_percent", "missing > 0"),
    **{name: _report(name) for name in _INVALID},
    "row_counts": _report("source_rows", "rows_after_cleaning"),
    "quality_report": _report("source_rows", "rows_after_cleaning", "duplicate_rows", *_INVALID),
    "quality_report_by_digest": _report("source_rows", "rows_after_cleaning", "duplicate_rows", *_INVALID),
    "clean": _enriched((*BASE, *CLEANING_FEATURES)),
    **{name: _enriched(("row_id", name)) for name in FEATURE_SQL},
    "engineer_features": on_enriched(_portable(EXPECTED_COLUMNS, "enriched")),
    "enriched_from_raw": _enriched(),
    "filter_options": on_refreshed(_options()),
    "date_bounds": on_refreshed(
        "SELECT CAST(min(order_date) AS VARCHAR) AS min_date, CAST(max(order_date) AS VARCHAR) AS max_date FROM retail"
    ),
    "filter_members": on_refreshed(_portable(EXPECTED_COLUMNS, f"retail WHERE {_NARROW_MEMBERS}")),
    "filter_date_range": on_refreshed(_portable(EXPECTED_COLUMNS, f"retail WHERE {_NARROW_DATES}")),
    "filter_all_options": on_refreshed(_portable(EXPECTED_COLUMNS, f"retail WHERE {_ALL_OPTIONS}")),
    "empty_guard": on_warehouse(
        f"""SELECT count(*) = 0 AS is_empty FROM retail WHERE {_NARROW_MEMBERS} AND {_NARROW_DATES}
UNION ALL SELECT count(*) = 0 FROM retail WHERE region = 'ASIA' AND segment = 'no such segment'"""
    ),
}


_FINE = f"""fine AS (
  SELECT * REPLACE (CAST(sales + CAST(row_id * 7919 % 100 AS DECIMAL(18,4)) / 10000 AS DECIMAL(28,4)) AS sales) FROM enriched
), selected AS (SELECT * FROM fine WHERE {_ALL_OPTIONS})"""
ENRICHED_SQL = {
    "rfm_scores_enriched": _with(LINES, RAW, CLEAN, ENRICHED_RAW, _FINE)(_RFM_SCORES),
    "discount_margin_curve_enriched": _with(LINES, RAW, CLEAN, ENRICHED_RAW, _selected(_ALL_OPTIONS).replace("FROM retail", "FROM enriched"))(
        f"""SELECT CAST(discount_percentage AS DOUBLE) AS discount_percentage,
  CAST(sum({_typed("profit_margin", "DECIMAL(20,16)")}) AS DOUBLE) / nullif(count(profit_margin), 0) AS avg_margin, {O} AS orders
FROM selected WHERE discount_percentage IS NOT NULL GROUP BY selected.discount_percentage"""
    ),
}


def statements() -> dict[str, str]:
    all_options, narrow = _selected(_ALL_OPTIONS), _selected(f"{_NARROW_MEMBERS} AND {_NARROW_DATES}")
    on_selected = _with(LINES, WAREHOUSE, all_options)
    on_narrow = _with(LINES, WAREHOUSE, narrow)
    on_refreshed_selected = _with(LINES, RAW, CLEAN, REFRESHED, all_options)
    on_refreshed_narrow = _with(LINES, RAW, CLEAN, REFRESHED, narrow)
    return {
        **OTHER_SQL,
        **ENRICHED_SQL,
        **{n: on_warehouse(ORDER_SQL[n]) for n in ORDER_REPORTS},
        **{n: on_selected(SELECTED_SQL[n]) for n in SELECTED_REPORTS},
        **{f"{n}_narrow": on_narrow(SELECTED_SQL[n]) for n in NARROW_REPORTS},
        **{f"{n}_refreshed": on_refreshed(ORDER_SQL[n]) for n in ORDER_REPORTS},
        **{f"{n}_refreshed": on_refreshed_selected(SELECTED_SQL[n]) for n in SELECTED_REPORTS},
        **{f"{n}_rolled": on_refreshed(ORDER_SQL[n]) for n in ROLLED_ORDER_REPORTS},
        **{f"{n}_rolled": on_refreshed_selected(SELECTED_SQL[n]) for n in ROLLED_SELECTED_REPORTS},
        **{f"{n}_rolled_narrow": on_refreshed_narrow(SELECTED_SQL[n]) for n in ROLLED_SELECTED_REPORTS},
    }
