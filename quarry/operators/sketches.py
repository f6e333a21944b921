"""Summaries of groups that merge: kept as a column, by day say, and put together for any
longer time without reading the rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 to this power registers of a distinct count; the error is 1.04 / sqrt of that, one in 61.
LG_K = 12
#: The size of a quantile sketch; ranks are off by less than one in a hundred for this.
KLL_K = 200


def summarised(df: DataFrame, by: list[Column], distinct: str, value: str) -> DataFrame:
    """The groups with `users`, a sketch of distinct values, `spread`, a sketch of quantiles
    (both binary), and n, the number of values; nulls do not count. A group without values has
    empty sketches."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(distinct, LG_K).alias("users"), F.kll_sketch_agg_double(value, KLL_K).alias("spread"), F.count(value).alias("n"))


def merged(summaries: DataFrame, by: list[Column]) -> DataFrame:
    """Summaries of longer times; sketches of the parts of a group merge before the shuffle."""
    return summaries.groupBy(*by).agg(F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"), F.sum("n").alias("n"))
