"""Sources (CSV inputs, stand-in views on the driver tables, stored results) and sinks."""

from .folders import read_csv_folder
from .lookups import look_up, write_lookup_table
from .readers import (driver_tables, fixture_etl_sources, fixture_shares, fixture_views, load_sources,
                      read_csv_by_name, read_orders, read_summary, read_table,
                      read_training_purchases)
from .sinks import write_csv, write_json, write_summary, write_tables

__all__ = ["driver_tables", "fixture_etl_sources", "fixture_shares", "fixture_views", "load_sources", "look_up", "read_summary", "read_table",
           "read_csv_by_name", "read_csv_folder", "read_orders", "read_training_purchases", "write_csv", "write_json",
           "write_lookup_table", "write_summary", "write_tables"]
