"""Joins on time: the latest earlier row, and rows within a span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import refuse, unused


def as_of_join(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str], span_seconds: int = 86_400) -> DataFrame:
    """left with, for each row, the values of right's latest row of the same `by` at or
    before `time`; null where there is none. Of right's rows at one time the greatest
    values count. Columns of left that are named like a value are replaced. Names that
    begin with `_` and are used here (_by, _at, _v, _span, _side) must not occur in left.

    Both sides are dealt by key and span of time, so that a key with very many rows is
    many groups. A row whose span has nothing earlier takes the last values of the
    nearest span before, from a table with one row for each key and span."""
    refuse(left, ["_by", "_at", "_v", "_span", "_side"], "left")
    marked = F.struct(*[F.col(v) for v in values])
    span = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / span_seconds)
    right = right.select(F.col(by).alias("_by"), F.col(time).alias("_at"), marked.alias("_v")).withColumn("_span", span("_at")).where("_by is not null and _at is not null")
    rows = left.select("*", F.col(by).alias("_by"), F.col(time).alias("_at"), F.lit(None).cast(right.schema["_v"].dataType).alias("_v"), span(time).alias("_span"), F.lit(1).alias("_side"))
    both = rows.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    here = Window.partitionBy("_by", "_span").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(here)).where("_side = 1")
    # The last values before each span that has rows of either side.
    lasts = right.groupBy("_by", "_span").agg(F.max(F.struct("_at", "_v")).alias("_last"))
    spans = lasts.unionByName(rows.select("_by", "_span").distinct(), allowMissingColumns=True).groupBy("_by", "_span").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_by").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_by", "_span", F.last("_last", ignorenulls=True).over(before)["_v"].alias("_before"))
    out = found.join(spans, ["_by", "_span"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    return out.select(*[c for c in left.columns if c not in values], *[F.col("_v")[v].alias(v) for v in values])


def within_join(left: DataFrame, right: DataFrame, by: str, time: str, seconds: int, prefix: str = "next_") -> DataFrame:
    """Pairs of a left row and a right row of the same `by` that is up to `seconds`
    later. The right side's columns get the prefix; it is an error if left has such names. Rows
    of a null `by` or time have no partner.

    Time is cut into spans of that length: a left row meets its own span and the next,
    so the join is an equi-join with a filter."""
    refuse(left, [prefix + c for c in right.columns], "left")
    span = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    right = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    mine, other = unused(left, "_span"), unused(right, "_span_of_right")
    right = right.withColumn(other, span(prefix + time))
    left = left.withColumn(mine, F.explode(F.array(span(time), span(time) + 1)))
    gap = F.col(prefix + time) - F.col(time)
    zero, most = F.expr("INTERVAL '0' SECOND"), F.make_dt_interval(secs=F.lit(seconds))
    return left.join(right, (F.col(mine) == F.col(other)) & (F.col(by) == F.col(prefix + by))).where((gap > zero) & (gap <= most)).drop(mine, other)
