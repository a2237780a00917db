"""chunkloom: deduplication analytics over chunk streams, expressed as PySpark DataFrames."""
