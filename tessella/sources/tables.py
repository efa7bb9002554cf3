"""Parquet table access: one file or one folder per table under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
