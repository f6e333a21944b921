"""Writing a table in a file format and reading it back with its own schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "orc", "json", "csv")


def save(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.format(kind).mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def load(like: DataFrame, path: str, kind: str) -> DataFrame:
    """Read with the given frame's schema, never inferring one."""
    reader = like.sparkSession.read.format(kind).schema(like.schema)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)
