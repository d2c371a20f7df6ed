"""Column functions: each takes and gives Spark columns, so that expressions stay inside generated code."""
