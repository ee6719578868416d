"""URL and hostname risk analytics as Spark DataFrame, ML and streaming jobs."""
