"""Tessera: Spark-first analytics for location-based service directories."""
