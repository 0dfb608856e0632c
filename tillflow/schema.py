"""Column lists, types and fixed vocabularies of the retail fact table."""

from __future__ import annotations

from pyspark.sql import types as T

# Header row of a raw order-line file.
RAW_HEADERS = (
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID",
    "Customer Name", "Segment", "Country", "City", "State", "Postal Code", "Region",
    "Product ID", "Category", "Sub-Category", "Product Name", "Sales", "Quantity",
    "Discount", "Profit",
)

# Cell texts that a raw file uses for "no value" (besides an empty cell).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_DATE, _TEXT, _INT, _LONG = T.DateType(), T.StringType(), T.IntegerType(), T.LongType()
_FLAG, _RATIO = T.BooleanType(), T.DoubleType()

# Name -> type after cleaning. Money keeps the four decimals of the raw file, quantities their fractions; the
# types are wide, so that no plausible number is lost.
BASE_TYPES: dict[str, T.DataType] = {
    "row_id": _LONG,
    "order_id": _TEXT,
    "order_date": _DATE,
    "ship_date": _DATE,
    "ship_mode": _TEXT,
    "customer_id": _TEXT,
    "customer_name": _TEXT,
    "segment": _TEXT,
    "country": _TEXT,
    "city": _TEXT,
    "state": _TEXT,
    "postal_code": _LONG,
    "region": _TEXT,
    "product_id": _TEXT,
    "category": _TEXT,
    "sub_category": _TEXT,
    "product_name": _TEXT,
    "sales": T.DecimalType(28, 4),
    "quantity": T.DecimalType(18, 4),
    "discount": T.DecimalType(9, 4),
    "profit": T.DecimalType(28, 4),
}

# The derived columns and their types.
CLEAN_TYPES: dict[str, T.DataType] = {
    **BASE_TYPES,
    "profit_margin": _RATIO,
    "order_year": _INT,
    "order_month": _INT,
    "order_month_name": _TEXT,
    "order_quarter": _INT,
    "revenue_per_unit": _RATIO,
    "discount_percentage": T.DecimalType(11, 4),
    "discount_band": _TEXT,
    "shipping_days": _INT,
    "weekend_flag": _FLAG,
    "profitability_flag": _FLAG,
}

EXPECTED_COLUMNS = tuple(CLEAN_TYPES)

# Types of the warehouse table. row_id is 64-bit: a 100 TB table has more than 2^31 order lines.
WAREHOUSE_TYPES: dict[str, T.DataType] = {
    **CLEAN_TYPES,
    "postal_code": _INT,
    "sales": T.DecimalType(12, 2),
    "quantity": _INT,
    "discount": T.DecimalType(5, 2),
    "profit": T.DecimalType(12, 2),
    "profit_margin": T.DecimalType(6, 4),
    "revenue_per_unit": T.DecimalType(12, 2),
    "discount_percentage": T.DecimalType(6, 2),
}

WAREHOUSE_SCHEMA = T.StructType(
    [T.StructField(name, dtype, True) for name, dtype in WAREHOUSE_TYPES.items()]
)



def _names(types: dict[str, T.DataType], *kinds: type[T.DataType]) -> tuple[str, ...]:
    return tuple(name for name, dtype in types.items() if isinstance(dtype, kinds))


DATE_COLUMNS = _names(CLEAN_TYPES, T.DateType)
FLAG_COLUMNS = _names(CLEAN_TYPES, T.BooleanType)
# Coerced to numbers while cleaning, the row id apart; every other raw column stays text or becomes a date.
RAW_NUMERIC_COLUMNS = tuple(c for c in _names(BASE_TYPES, T.NumericType) if c != "row_id")
# Descriptive text is trimmed; identifiers are left as they are.
TRIMMED_COLUMNS = tuple(c for c in _names(BASE_TYPES, T.StringType) if not c.endswith("_id"))
# Coerced to numbers before a load.
LOAD_NUMERIC_COLUMNS = _names(CLEAN_TYPES, T.NumericType)
