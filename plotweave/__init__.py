"""plotweave: linking, measuring and clustering large geospatial graphs on Spark."""
