"""Evidence-gated analytics for curated records, built on Spark DataFrames."""
