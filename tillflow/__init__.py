"""Order-line analytics on Spark: cleaning, features, warehouse table, reports, customer segments."""

from tillflow.operators.basket import top_basket_pairs
from tillflow.operators.cleaning import clean, clean_with_report
from tillflow.operators.features import engineer_features
from tillflow.operators.filters import Selection, select_orders
from tillflow.operators.loading import align_schema, prepare_for_load
from tillflow.operators.rfm import rfm
from tillflow.plans.refresh import load_orders, refresh, refresh_warehouse
from tillflow.plans.views import register_views
from tillflow.sources.csv_files import read_processed, read_raw, write_processed
from tillflow.sources.warehouse import load_warehouse, scan_warehouse

__all__ = [
    "Selection", "align_schema", "clean", "clean_with_report", "engineer_features", "load_orders", "load_warehouse",
    "prepare_for_load", "read_processed", "read_raw", "refresh", "refresh_warehouse", "register_views", "rfm",
    "scan_warehouse", "select_orders", "top_basket_pairs", "write_processed",
]
