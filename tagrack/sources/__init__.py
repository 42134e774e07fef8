"""Parquet sources, the driver-table binding, derived requests, feed documents."""
