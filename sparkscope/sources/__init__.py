"""Sources: schemas, parsers of ingest payloads, and logical tables over the driver's parquet."""
