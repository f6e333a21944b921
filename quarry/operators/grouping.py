"""Groups of rows: the first few of each, places in large ones, and runs without a long
gap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import refuse, unused
from quarry.sources.shared import materialize


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1. Spark keeps n rows of a
    group on each side of the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def sessions(df: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """(by, started, ended, rows) of runs of rows no more than the gap apart; the native
    session window merges partial sessions before the shuffle."""
    at = F.col(time).cast("timestamp")
    grouped = df.groupBy(by, F.session_window(at, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("rows"), F.max(at).alias("ended"))
    return grouped.select(by, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "rows")


PLACES = ["row", "rank", "dense", "upto", "rows"]


def places(df: DataFrame, by: str, order: list[str], prefix: str = "_") -> DataFrame:
    """df with _row, _rank, _dense (from 1) and _upto, the number of rows up to and with
    the row's equals, by `order` within the group, and _rows, the group's size. Nulls come
    first; a null group is a group. The new names begin with `prefix`; it is an error if df has
    one of them. Other columns may have any names.

    A group need not fit into one task: rows are sorted by range over group and order,
    counted within each range, and lifted by the counts of the group's ranges before, from
    a table with one row for each group and range. Equal rows lie in one range."""
    new = {c: prefix + c for c in PLACES}
    refuse(df, list(new.values()), "df")
    spark = df.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span, of, lift = (unused(df, f"_{c}") for c in ("range", "of", "lift"))
    dealt = materialize(df.repartitionByRange(number, by, *order).withColumn(span, F.spark_partition_id()), "places")
    w = Window.partitionBy(span, by).orderBy(*order)
    local = dealt.withColumns({new["row"]: F.row_number().over(w), new["rank"]: F.rank().over(w), new["dense"]: F.dense_rank().over(w), new["upto"]: F.count("*").over(w)})
    sizes = dealt.groupBy(F.col(span).alias("span"), F.col(by).alias("by")).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*order)).alias("d"))
    before = Window.partitionBy("by").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    lifts = sizes.select(F.struct("span", "by").alias(of), F.struct(zero("n").alias("n"), zero("d").alias("d"), F.sum("n").over(Window.partitionBy("by")).alias("rows")).alias(lift))
    out = local.join(lifts, (F.col(span) == F.col(of)["span"]) & F.col(by).eqNullSafe(F.col(of)["by"]))
    lifted = [(F.col(new[c]) + F.col(lift)["d" if c == "dense" else "n"]).alias(new[c]) for c in PLACES[:-1]]
    return out.select(*[F.col(c) for c in df.columns], *lifted, F.col(lift)["rows"].alias(new["rows"]))


def medians(df: DataFrame, by: str, value: str, at: list[float], names: list[str], prefix: str = "_") -> DataFrame:
    """(by, *names): exact percentiles of each group, interpolated between neighbours, by the
    places of its values; nulls do not count. A group need not fit into one task."""
    placed = places(df.where(F.col(value).isNotNull()).select(by, value), by, [value], prefix)
    row, rows = F.col(f"{prefix}row"), F.col(f"{prefix}rows")
    out = []
    for p, name in zip(at, names):
        place = (rows - 1) * p
        low, share = F.floor(place), place - F.floor(place)
        lower, upper = F.max(F.when(row == low + 1, F.col(value))), F.max(F.when(row == F.least(low + 2, rows), F.col(value)))
        out.append((lower + (upper - lower) * F.max(share)).alias(name))
    return placed.groupBy(by).agg(*out)


def folded_text(df: DataFrame, by: str, order: list[str], text: str, label: str) -> DataFrame:
    """(by, labels, digest) of each group in the order given: its labels joined by ">", and the
    MD5 of its texts joined by line ends. Null labels and texts are left out; a null group is
    a group. MD5 reads a text from front to back, so a group's rows meet in one task, sorted
    there; a worker holds one batch of them and the labels."""
    kinds = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels, digest, begun = None, [], None, False

        def close() -> pa.RecordBatch:
            values = [pa.array([now], kind), pa.array([">".join(labels)]), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(values, ["by", "labels", "digest"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("by").type
            for group, name, one in zip(*(batch.column(c).to_pylist() for c in ("by", "label", "text"))):
                if digest is None or group != now:
                    if digest is not None:
                        yield close()
                    now, labels, digest, begun = group, [], hashlib.md5(usedforsecurity=False), False
                if name is not None:
                    labels.append(name)
                if one is not None:
                    digest.update((b"\n" if begun else b"") + one.encode())
                    begun = True
        if digest is not None:
            yield close()

    rows = df.select(F.col(by).alias("by"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(label).alias("label"), F.col(text).alias("text"))
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(number, "by").sortWithinPartitions("by", *[f"o{i}" for i in range(len(order))])
    return dealt.select("by", "label", "text").mapInArrow(run, f"by {kinds}, labels string, digest string").withColumnRenamed("by", by)
