"""Tables laid out for joins: dealt and sorted by a key once, joined on it without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quarry.sources.shared import fresh_path


def bucketed(df: DataFrame, key: str, number: int) -> DataFrame:
    """df as a table of `number` buckets by key, each sorted by it, in the shared folder. Two
    tables of the same number join on the key bucket by bucket. Rows of a null key are in the
    first bucket. A key with very many rows is one bucket's: such tables are for keys that are
    about unique or evenly spread."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(number, key).write.bucketBy(number, key).sortBy(key).option("path", fresh_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)
