"""Windows over a span of time, for groups of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import refuse, unused


def range_frame(df: DataFrame, by: str, time: str, seconds: int, new: dict[str, Column]) -> DataFrame:
    """df with new columns: aggregates over the rows of the same `by` from `seconds` before
    the row's time up to that time, as RANGE BETWEEN INTERVAL ... PRECEDING AND CURRENT ROW has
    it. It is an error if df has one of these names.

    Rows are dealt by `by` and spans of the frame's length, so a group with very many rows is
    as many groups as it has spans; each row goes to its own span and, to lie in the frames of
    the next one's rows, to that. The frames of a null time hold the group's rows of a null
    time; a null `by` is a group."""
    refuse(df, list(new), "df")
    at, span, own = (unused(df, c) for c in ("_at", "_span", "_own"))
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    length = seconds * 1_000_000
    mine = F.floor(micros / length)
    places = F.when(mine.isNull(), F.array(mine)).otherwise(F.array(mine, mine + 1))
    rows = df.select("*", micros.alias(at), F.posexplode(places).alias(own, span))
    w = Window.partitionBy(by, span).orderBy(at).rangeBetween(-length, Window.currentRow)
    return rows.withColumns({name: c.over(w) for name, c in new.items()}).where(F.col(own) == 0).drop(at, span, own)
