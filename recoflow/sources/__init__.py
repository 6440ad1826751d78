"""Sources: parquet tables, fixture views, TSV readers."""
