"""Findings, or any relation of the engine, as Parquet: an addition for results that no workbook holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A folder of Parquet files, replaced if there; in folders by the columns of by, with few files in each: a value with many rows is split by size among tasks."""
    if by:
        rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
