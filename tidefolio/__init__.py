"""Portfolio analytics on Spark: every table is long, keyed by (date, code)."""
