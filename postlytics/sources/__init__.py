"""Scans and sinks: driver tables, post views over them, CSV/JSON/Parquet IO."""

from postlytics.sources.tables import load, posts_from_events, karma_posts_from_orders
from postlytics.sources.files import (read_csv_tolerant, read_csv_strict, read_string_list,
                                     read_object_names, read_keyword_csv, read_id_url_map,
                                     last_url_per_id, write_csv, write_replace, write_append)

__all__ = ["load", "posts_from_events", "karma_posts_from_orders", "read_csv_tolerant",
           "read_csv_strict", "read_string_list", "read_object_names", "read_keyword_csv",
           "read_id_url_map", "last_url_per_id", "write_csv", "write_replace", "write_append"]
