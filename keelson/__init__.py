"""Keyed records kept as an append-only log, resolved and queried with Spark DataFrames."""
