"""Tables in and out: whatever Spark reads and writes, Parquet by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(f"{sf_dir}/{name}.{fmt}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    df.write.format(fmt).mode(mode).options(**options).save(path)


def from_rows(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """A frame from a list of dicts, with ``id`` by position if there is none."""
    rows = [row if "id" in row else {"id": k, **row} for k, row in enumerate(rows)]
    return spark.createDataFrame(rows, schema)


def with_gold(df: DataFrame, labels: DataFrame, on: str, label: str, name: str = "gold") -> DataFrame:
    """``df`` with the label of each row, -1 where there is none."""
    return df.join(labels.select(on, F.col(label).alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(-1)))
