"""Feature tables over Parquet, and generators of synthetic ones."""
