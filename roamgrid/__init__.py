"""Road-network analytics on Spark: ingest, snap and route with DataFrames."""
