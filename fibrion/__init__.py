"""Single-molecule footprint analytics on Spark."""
