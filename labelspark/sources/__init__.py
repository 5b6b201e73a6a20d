"""Sources and sinks: the given parquet tables and the annotated-set formats."""
