"""Relational operators that Spark has no single method for."""
