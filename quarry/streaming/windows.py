"""Streaming aggregations over the events.

Each runs the files of the table through a stream until they are used up, into a table
of Parquet files in the shared folder, and returns that table's last state. Event time
is zoned for the watermark and given back without a zone. Every state has a window in
its key, so it is dropped once the watermark has passed; rows that come later than that
are dropped too. Rows of a null time belong to no window. Repeated rows count each. An
empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.shared import fresh_path


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders; a single file is named by a glob.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")


def finished(stream: DataFrame, keys: list[str]) -> DataFrame:
    """All updates of the stream, the last for each key. Batches are written to their
    own folder each, so that one that is run again replaces itself."""
    spark = stream.sparkSession
    base = fresh_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema, T.StructField("_batch", T.IntegerType())])
    if not query.lastProgress:  # no file, no batch
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return last.select(*keys, "v.*")


def tumbling(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Counts and sums by day and type."""
    rows = events(spark, sf_dir, files_per_batch).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return finished(rows.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total"), ["started", "event_type"])


def sliding(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Events and users of a day, every six hours. The state has one row for each window
    and user; windows are summed up from the stream's table."""
    rows = events(spark, sf_dir, files_per_batch).groupBy(F.window("at", "1 day", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    each = finished(rows.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "user_id", "n"), ["started", "user_id"])
    return each.groupBy("started").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"))


def first_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """When each user first did what. The state has the first of each day; the first of
    all is found in the stream's table."""
    rows = events(spark, sf_dir, files_per_batch).groupBy(F.window("at", "1 day").alias("w"), "user_id", "event_type").agg(F.min("at").cast("timestamp_ntz").alias("first_ts"))
    each = finished(rows.select(F.col("w.start").alias("day"), "user_id", "event_type", "first_ts"), ["day", "user_id", "event_type"])
    return each.groupBy("user_id", "event_type").agg(F.min("first_ts").alias("first_ts"))
