"""Spark-first analytics over dated, sourced evidence: event store, search, integrity, forecasts."""
