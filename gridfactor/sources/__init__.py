"""Named matrices in Parquet, and job configuration."""
