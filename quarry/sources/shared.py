"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset (tests, one machine) a folder under the warehouse is used."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    base = conf or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/quarry/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage,
    and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. To be called once the results
    of its queries have been read or written, since they are computed from these."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
