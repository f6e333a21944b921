"""Functions of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
