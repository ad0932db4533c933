"""Input tables: base parquet scans and the fixture views over them."""
