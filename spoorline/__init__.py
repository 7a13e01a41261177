"""Spoorline: lineage analytics over run-event data, written as Spark DataFrame jobs."""
