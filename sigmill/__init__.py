"""sigmill: telemetry analytics as functions from DataFrames to DataFrames."""
