"""Quarry: analytics operators written as Spark DataFrame jobs."""
