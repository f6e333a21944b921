"""Queries that each need a mechanism of their own: frames over a span of time, sketches,
recursion, lateral joins, variants, bucketed tables, table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.bucketed import bucketed
from quarry.operators.frames import range_frame
from quarry.operators.sketches import merged, summarised
from quarry.sources import table
from quarry.sources.shared import materialize

BANDS = 8


def recent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the number and value of its user's events of the six hours up to it."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    framed = range_frame(rows, "user_id", "ts", 6 * 3600, {"recent": F.count("*"), "recent_value": F.sum("value"), "dearest": F.max("value")})
    return framed.select("event_id", "user_id", "recent", F.round("recent_value", 4).alias("recent_value"), "dearest")


def weekly_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the median value of each week and type from daily sketches, beside the exact
    number: whether the estimate is within four standard errors (or one user), and whether the
    estimated median's rank is within two hundredths of the middle."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id", "value")
    days = materialize(summarised(rows, [F.col("day"), F.col("event_type")], "user_id", "value"), "daily-sketches")
    week = F.date_trunc("week", "day").cast("date").alias("week")
    told = merged(days, [week, F.col("event_type")]).select("week", "event_type", "n", F.hll_sketch_estimate("users").alias("users"), F.kll_sketch_get_quantile_double("spread", F.lit(0.5)).alias("middle"))
    exact = rows.groupBy(week, "event_type").agg(F.count_distinct("user_id").alias("exact_users"))
    upto = rows.join(told.select(F.col("week").alias("w"), F.col("event_type").alias("e"), "middle"), (F.date_trunc("week", "day").cast("date") == F.col("w")) & (F.col("event_type") == F.col("e")))
    ranks = upto.groupBy(F.col("w").alias("week"), "event_type").agg(F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("rank"))
    both = told.join(exact, ["week", "event_type"]).join(ranks, ["week", "event_type"])
    near = F.abs(F.col("users") - F.col("exact_users")) <= F.greatest(F.lit(1.0), F.col("exact_users") * 4 * 1.04 / 64)
    return both.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n", "exact_users", near.alias("users_within"), (F.abs(F.col("rank") - 0.5) <= F.greatest(F.lit(0.02), 1.5 / F.col("n"))).alias("median_within"))


def months_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every month from the first to the last, those without any included. The months
    come from a recursive query, one level each, which Spark bounds at 1,000 here."""
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_months")
    try:
        months = materialize(
            spark.sql("""
WITH RECURSIVE span AS (
  SELECT CAST(trunc(min(o_orderdate), 'MM') AS DATE) AS first, CAST(trunc(max(o_orderdate), 'MM') AS DATE) AS last FROM orders_of_months),
months(m, last) AS (
  SELECT first, last FROM span WHERE first IS NOT NULL
  UNION ALL
  SELECT CAST(add_months(m, 1) AS DATE), last FROM months WHERE m < last)
SELECT m FROM months"""),
            "months",
        )
    finally:
        spark.conf.set("spark.sql.cteRecursionLevelLimit", before)
        spark.catalog.dropTempView("orders_of_months")
    counted = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return months.join(counted, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


def dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest orders of each customer, those without any included, by a lateral join,
    which Spark turns into ranks within customers and a join."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return customers.lateralJoin(best, how="left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


def variant_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a property read from variants. Text that is no JSON counts as malformed, a
    missing path or a value of another type as missing."""
    rows = table(spark, sf_dir, "events").select("event_type", "props", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "long")
    return rows.groupBy("event_type", F.floor(k / 25).alias("quarter")).agg(
        F.count("*").alias("n"),
        F.sum(k).alias("total"),
        F.count_if(F.col("v").isNull() & F.col("props").isNotNull()).alias("malformed"),
        F.count_if(F.try_variant_get("v", "$.nested.deeper[0]", "string").isNull()).alias("missing"),
    )


def bucketed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the priority of their orders, from tables bucketed by the order."""
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", number)
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), "l_orderkey", number)
    return order_lines(orders, lines).groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def order_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


def band_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy of each vector in bands of its frequencies: one row to BANDS rows, batch by
    batch and without a shuffle. Spark has no Fourier transform, and one made of its array
    functions takes the square of a vector's length where numpy's takes n log n. Vectors that
    are null, empty or hold a null have no rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.mapInArrow(_bands, "vec_id long, band int, energy double").withColumn("energy", F.round("energy", 6))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bands, energies = [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            if v and None not in v:
                power = np.abs(np.fft.rfft(np.array(v, np.float64))) ** 2
                ids += [i] * BANDS
                bands += range(BANDS)
                energies += [float(p.sum()) for p in np.array_split(power, BANDS)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.int32()), pa.array(energies, pa.float64())], ["vec_id", "band", "energy"])


QUERIES = {f.__name__: f for f in (recent_load, weekly_sketches, months_of_orders, dearest_orders, variant_properties, bucketed_lines, band_energies)}

SQL = {
    "recent_load": """
SELECT event_id, user_id, count(*) OVER w AS recent, round(sum(value) OVER w, 4) AS recent_value, max(value) OVER w AS dearest FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""",
    "weekly_sketches": """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(value) AS n, count(DISTINCT user_id) AS exact_users, true AS users_within, true AS median_within
FROM events GROUP BY 1, 2""",
    "months_of_orders": """
WITH RECURSIVE span AS (SELECT date_trunc('month', min(o_orderdate)) AS first, date_trunc('month', max(o_orderdate)) AS last FROM orders),
months AS (SELECT first AS m, last FROM span UNION ALL SELECT m + INTERVAL 1 MONTH, last FROM months WHERE m < last)
SELECT strftime(m, '%Y-%m') AS month, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM months LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m""",
    "dearest_orders": """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o ON true""",
    "variant_properties": """
SELECT event_type, CAST(floor(k / 25) AS BIGINT) AS quarter, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, count(*) FILTER (NOT good AND props IS NOT NULL) AS malformed, count(*) AS missing FROM (
  SELECT event_type, props, coalesce(json_valid(props), false) AS good, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
GROUP BY 1, 2""",
    "bucketed_lines": """
SELECT o_orderpriority, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "band_energies": """
WITH waves AS (
  SELECT vec_id, k, list_sum(list_transform(embedding, lambda x, i: x * cos(2 * pi() * k * (i - 1) / len(embedding)))) AS a,
    list_sum(list_transform(embedding, lambda x, i: x * sin(2 * pi() * k * (i - 1) / len(embedding)))) AS b, len(embedding) // 2 + 1 AS size
  FROM embeddings, (SELECT unnest(range(4096)) AS k) WHERE k <= len(embedding) // 2),
placed AS (
  SELECT vec_id, a * a + b * b AS power, CASE WHEN k < (size % 8) * (size // 8 + 1) THEN k // (size // 8 + 1) ELSE size % 8 + (k - (size % 8) * (size // 8 + 1)) // (size // 8) END AS band FROM waves)
SELECT vec_id, CAST(band AS INTEGER) AS band, round(sum(power), 6) AS energy FROM placed GROUP BY ALL""",
}
