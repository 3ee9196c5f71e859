"""Parquet tables of one directory, read with their stored schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; a single file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
