"""One registered query per operator. Each takes (session, folder of inputs)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks.workspace import COPY_OFFSET, Workspace, workspace
from tillflow.operators import basket, cleaning, copies, dates, features, filters, loading, rfm
from tillflow.operators.filters import Selection
from tillflow.plans import business, dashboard, exploration, refresh, rollup, views
from tillflow.schema import RAW_NUMERIC_COLUMNS, TRIMMED_COLUMNS
from tillflow.scratch import new_path
from tillflow.sources import csv_files, warehouse

Build = Callable[[Workspace], DataFrame]

NARROW = Selection(
    regions=("ASIA", "EUROPE"),
    segments=("BUILDING", "MACHINERY", "FURNITURE"),
    categories=("ECONOMY", "SMALL", "STANDARD"),
    start=dt.date(1996, 3, 15),
    end=dt.date(1999, 10, 31),
)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as ISO text, so that results of two engines compare."""

    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return value.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(value, "yyyy-MM-dd").alias(field.name)
        return value

    return df.select(*[column(f) for f in df.schema.fields])


# ---- sources, sinks, catalog ----------------------------------------------------------------


def _standardized(ws: Workspace) -> DataFrame:
    return cleaning.standardize(ws.raw)


def _enriched_raw(ws: Workspace) -> DataFrame:
    return refresh.refresh(ws.spark, ws.raw_path)[0]


def _round_trip(file_format: str) -> Build:
    def build(ws: Workspace) -> DataFrame:
        path = new_path(ws.spark, "processed")
        refresh.refresh(ws.spark, ws.raw_path, path, file_format)
        return csv_files.read_processed(ws.spark, path, file_format)

    return build


def _resolved(ws: Workspace) -> DataFrame:
    """No table and no processed files yet, so both are made from the second raw path."""
    absent, processed = new_path(ws.spark, "absent"), new_path(ws.spark, "processed")
    return refresh.load_orders(ws.spark, "no_such_table", processed, (absent, ws.raw_path))


def _views_in_sql(ws: Workspace) -> DataFrame:
    names = views.register_views(ws.spark, ws.table)
    counts = [f"SELECT '{n}' AS view_name, count(*) AS row_count FROM {n}" for n in names]
    return ws.spark.sql(" UNION ALL ".join(counts))


def _broken_keys(ws: Workspace) -> DataFrame:
    """Copies get the id of their original, and lines without a region lose their order."""
    lines = _standardized(ws)
    return loading.key_violations(
        lines.withColumns(
            {
                "row_id": F.col("row_id") % COPY_OFFSET,
                "order_id": F.when(F.col("region").isNotNull(), F.col("order_id")),
            }
        )
    )


def _salvage(ws: Workspace) -> csv_files.Salvage:
    return csv_files.salvage_raw(ws.spark, ws.broken_path)


def _salvage_counts(ws: Workspace) -> DataFrame:
    counts = _salvage(ws).counts
    return ws.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


SOURCES: dict[str, Build] = {
    "scan_raw_csv": lambda ws: cleaning.normalize_headers(ws.raw),
    "null_tokens": lambda ws: cleaning.normalize_headers(cleaning.null_tokens(ws.raw)),
    "normalize_headers": lambda ws: cleaning.normalize_headers(ws.raw).select("sub_category", "postal_code", "row_id"),
    "write_processed": _round_trip("parquet"),
    "scan_processed": _round_trip("csv"),
    "load_warehouse": lambda ws: ws.refreshed_orders,
    "warehouse_schema": lambda ws: loading.to_warehouse(ws.enriched),
    "scan_warehouse": lambda ws: ws.orders,
    "resolve_source": _resolved,
    "table_stats": lambda ws: warehouse.table_stats(ws.orders),
    "align_schema": lambda ws: loading.align_schema(ws.orders.select(*reversed(ws.orders.columns))),
    "prepare_for_load": lambda ws: loading.prepare_for_load(_enriched_raw(ws)),
    "register_views": _views_in_sql,
    "key_checks": _broken_keys,
    "salvage_raw_lines": lambda ws: cleaning.normalize_headers(_salvage(ws).lines),
    "salvage_rejected_lines": lambda ws: _salvage(ws).rejected.select(F.substring_index("line", ",", 1).alias("row_id")),
    "salvage_counts": _salvage_counts,
    "append_arrivals": lambda ws: ws.arrived_orders.select(*[c for c in ws.arrived_orders.columns if c != "row_id"]),
}

# ---- cleaning and quality report ------------------------------------------------------------


def _report(ws: Workspace) -> DataFrame:
    return cleaning.clean_with_report(ws.raw)[1]


def _report_columns(*names: str) -> Build:
    return lambda ws: _report(ws).select(*names)


INVALID = ("invalid_sales", "invalid_quantity", "invalid_discount", "invalid_dates")

CLEANING: dict[str, Build] = {
    "coerce_numeric": lambda ws: _standardized(ws).select("row_id", *RAW_NUMERIC_COLUMNS),
    "coerce_dates": lambda ws: _standardized(ws).select("row_id", "order_date", "ship_date"),
    "date_formats": lambda ws: dates.date_formats(ws.exports, by=["export"]).drop("tied"),
    "parse_mixed_dates": lambda ws: dates.parse_mixed_dates(ws.exports, by=["export"]).select("row_id", "order_date", "ship_date"),
    "trim_text": lambda ws: _standardized(ws).select("row_id", *TRIMMED_COLUMNS),
    "dedup_ignoring_row_id": lambda ws: cleaning.dedup_ignoring_row_id(_standardized(ws)),
    "dedup_by_digest": lambda ws: copies.fold_copies_by_digest(_standardized(ws)).drop(cleaning.COPIES),
    "duplicate_rows": _report_columns("duplicate_rows"),
    "missing_values": lambda ws: cleaning.missing_by_column(_report(ws)).select("column_name", "missing"),
    "missing_percent": lambda ws: cleaning.missing_by_column(_report(ws))
    .where("missing > 0")
    .select("column_name", "missing_percent"),
    **{name: _report_columns(name) for name in INVALID},
    "row_counts": _report_columns("source_rows", "rows_after_cleaning"),
    "quality_report": _report_columns("source_rows", "rows_after_cleaning", "duplicate_rows", *INVALID),
    "quality_report_by_digest": lambda ws: cleaning.quality_report(copies.fold_copies_by_digest(_standardized(ws))).select(
        "source_rows", "rows_after_cleaning", "duplicate_rows", *INVALID
    ),
    "clean": lambda ws: cleaning.clean(ws.raw),
}

# ---- features -------------------------------------------------------------------------------


def _feature(name: str) -> Build:
    return lambda ws: features.add_features(cleaning.dedup_ignoring_row_id(_standardized(ws)), [name]).select(
        "row_id", name
    )


FEATURES: dict[str, Build] = {
    **{name: _feature(name) for name in features.FEATURES},
    "engineer_features": lambda ws: ws.enriched,
    "enriched_from_raw": _enriched_raw,
}

# ---- filters --------------------------------------------------------------------------------

FILTERS: dict[str, Build] = {
    "filter_options": lambda ws: filters.filter_options(ws.refreshed_orders),
    "date_bounds": lambda ws: filters.date_bounds(ws.refreshed_orders),
    "filter_members": lambda ws: filters.filter_members(ws.refreshed_orders, NARROW),
    "filter_date_range": lambda ws: filters.filter_date_range(ws.refreshed_orders, NARROW),
    "filter_all_options": lambda ws: filters.select_orders(ws.refreshed_orders),
    "empty_guard": lambda ws: filters.is_empty(ws.selected(NARROW)).union(
        filters.is_empty(ws.selected(Selection(regions=("ASIA",), segments=("no such segment",))))
    ),
}

# ---- reports over the whole table -----------------------------------------------------------

ORDER_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **views.VIEWS,
    "executive_kpis": business.executive_kpis,
    "monthly_running": business.monthly_running,
    "region_category": business.region_category,
    "segment_customer_rank": business.segment_customer_rank,
    "product_double_rank": business.product_double_rank,
    "shipping_efficiency": business.shipping_efficiency,
    "discount_impact": business.discount_impact,
    "top10_customers_by_sales": business.top_customers_by_sales,
    "eda_monthly_by_name": exploration.monthly_by_name,
    "eda_region": exploration.region_summary,
    "eda_category": exploration.category_summary,
    "top15_products": exploration.top_products,
    "loss_makers": exploration.loss_making_products,
}

# ---- reports over selected orders -----------------------------------------------------------

SELECTED_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dash_kpis": dashboard.kpis,
    "dash_monthly": dashboard.monthly,
    "month_label": lambda df: dashboard.monthly(df).select("order_year", "order_month", "month_year"),
    "dash_cumulative": dashboard.cumulative,
    "dash_region": dashboard.region,
    "dash_segment_revenue": dashboard.segment_revenue,
    "dash_category_revenue": dashboard.category_revenue,
    "dash_segment_category": dashboard.segment_category,
    "dash_discount_band": dashboard.discount_bands,
    "dash_subcategory": dashboard.subcategory_sales,
    "dash_top10_profit_customers": dashboard.top_customers_by_profit,
    "dash_ship_days_by_mode": dashboard.ship_days_by_mode,
    "dash_ship_days_by_region": dashboard.ship_days_by_region,
    "dash_weekend": dashboard.weekend,
    "mom_growth": dashboard.month_growth,
    "discount_margin_curve": dashboard.discount_margin_curve,
    "discount_margin_correlation": dashboard.discount_margin_correlation,
    "basket_pairs": basket.top_basket_pairs,
    "basket_pairs_all": lambda df: basket.basket_pairs(df),
    "rfm_base": rfm.rfm_base,
    "rfm_scores": lambda df: rfm.rfm_scores(rfm.rfm_base(df)),
    "rfm_segment": rfm.rfm,
    "rfm_distribution": lambda df: rfm.rfm_distribution(rfm.rfm(df)),
    "rfm_financials": lambda df: rfm.rfm_financials(rfm.rfm(df)),
    "rfm_detail": lambda df: rfm.rfm_detail(rfm.rfm(df)),
    "state_performance": exploration.state_performance,
    "segment_share": exploration.segment_share,
    "shipping_distribution": exploration.shipping_distribution,
}

# ---- the same reports from a roll-up ---------------------------------------------------------

ROLLED_ORDER_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "executive_kpis": rollup.executive_kpis,
    "vw_monthly_sales": rollup.monthly_sales,
    "vw_region_performance": rollup.region_performance,
    "vw_category_performance": rollup.category_performance,
    "vw_shipping_analysis": rollup.shipping_analysis,
    "shipping_efficiency": rollup.shipping_efficiency,
    "discount_impact": rollup.discount_impact,
}
ROLLED_SELECTED_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dash_kpis": rollup.kpis,
    "dash_region": rollup.region,
    "dash_weekend": rollup.weekend,
    "shipping_distribution": rollup.shipping_distribution,
}

# Reports that also run on the narrow selection, and on the table refreshed from raw files.
NARROW_REPORTS = (
    "dash_kpis", "mom_growth", "dash_segment_category", "dash_weekend", "basket_pairs", "rfm_segment", "segment_share",
)


def _on_orders(report: Callable[[DataFrame], DataFrame]) -> Build:
    return lambda ws: report(ws.orders)


def _on_refreshed(report: Callable[[DataFrame], DataFrame]) -> Build:
    return lambda ws: report(ws.refreshed_orders)


def _on_selected(report: Callable[[DataFrame], DataFrame], selection: Selection) -> Build:
    return lambda ws: report(ws.selected(selection))


def _on_refreshed_selected(report: Callable[[DataFrame], DataFrame]) -> Build:
    return lambda ws: report(filters.select_orders(ws.refreshed_orders))


def _on_rolled(report: Callable[[DataFrame], DataFrame]) -> Build:
    return lambda ws: report(ws.rolled)


def _on_rolled_selected(report: Callable[[DataFrame], DataFrame], selection: Selection) -> Build:
    return lambda ws: report(filters.select_orders(ws.rolled, selection))


def _fine_money(ws: Workspace) -> DataFrame:
    """All lines of the processed table, with sales that differ in the third and fourth place as well."""
    lines = _enriched_raw(ws)
    places = (F.col("row_id") * 7919 % 100).cast("decimal(18,4)") / 10000
    return filters.select_orders(lines.withColumn("sales", (F.col("sales") + places).cast("decimal(28,4)")))


ENRICHED_REPORTS: dict[str, Build] = {
    "rfm_scores_enriched": lambda ws: rfm.rfm_scores(rfm.rfm_base(_fine_money(ws))),
    "discount_margin_curve_enriched": lambda ws: dashboard.discount_margin_curve(filters.select_orders(_enriched_raw(ws))),
}


def builds() -> dict[str, Build]:
    return {
        **SOURCES,
        **CLEANING,
        **FEATURES,
        **FILTERS,
        **ENRICHED_REPORTS,
        **{n: _on_orders(r) for n, r in ORDER_REPORTS.items()},
        **{n: _on_selected(r, Selection()) for n, r in SELECTED_REPORTS.items()},
        **{f"{n}_narrow": _on_selected(SELECTED_REPORTS[n], NARROW) for n in NARROW_REPORTS},
        **{f"{n}_refreshed": _on_refreshed(r) for n, r in ORDER_REPORTS.items()},
        **{f"{n}_refreshed": _on_refreshed_selected(r) for n, r in SELECTED_REPORTS.items()},
        **{f"{n}_rolled": _on_rolled(r) for n, r in ROLLED_ORDER_REPORTS.items()},
        **{f"{n}_rolled": _on_rolled_selected(r, Selection()) for n, r in ROLLED_SELECTED_REPORTS.items()},
        **{f"{n}_rolled_narrow": _on_rolled_selected(r, NARROW) for n, r in ROLLED_SELECTED_REPORTS.items()},
    }


def _query(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plain(build(workspace(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in builds().items()}
