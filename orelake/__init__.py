"""A lakehouse analytics engine on PySpark's public API: layered tables, quality rules, merges, history, star schemas."""
