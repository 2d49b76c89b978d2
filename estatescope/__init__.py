"""Readiness analytics for data platform estates, as plain Spark DataFrame jobs."""
