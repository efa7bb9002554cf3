"""Numbering all rows without sending them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.spread import spread_join


def with_ordinal(df: DataFrame, key: str, name: str = "ordinal", ties: list[str | Column] | None = None, slices: int = 64) -> DataFrame:
    """Adds the row number, from 0, in the order of a numeric key and ties.

    The key's range is cut at approximate quantiles into slices; rows are
    numbered inside their slice, and the counts of the earlier slices, one row
    per slice, are added. Many equal keys stay in one slice, so ties should be few.
    """
    cuts = sorted(set(df.approxQuantile(key, [i / slices for i in range(1, slices)], 0.005))) if slices > 1 else []
    at = F.lit(0)
    if cuts:
        at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(key)))
    cut = df.withColumn("_slice", at)
    counts = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    base = counts.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_slice").orderBy(key, *(ties or []))
    # at most `slices` rows
    return cut.withColumn("_no", F.row_number().over(inner) - 1).join(F.broadcast(base), "_slice").withColumn(name, F.col("_no") + F.col("_base")).drop("_slice", "_no", "_base")


def with_number_in(df: DataFrame, by: str, key: str, name: str, ties: list[str | Column] | None = None, slices: int = 64) -> DataFrame:
    """Adds each row's number, from 1, in its group, in the order of a numeric key and ties; every row keeps its place.

    Groups are cut at the key's quantiles as in with_ordinal, so a group with
    many of the rows is numbered by many tasks; a row that holds no group or key
    is numbered with its like.
    """
    cuts = sorted(set(df.approxQuantile(key, [i / slices for i in range(1, slices)], 0.005))) if slices > 1 else []
    at = F.lit(0)
    if cuts:
        at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(key)))
    cut = df.withColumn("_slice", at)
    # at most `slices` rows per group
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(by, "_slice").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    numbered = cut.withColumn("_no", F.row_number().over(Window.partitionBy(by, "_slice").orderBy(key, *(ties or []))))
    out = spread_join(numbered, base, [by, "_slice"], "_n", F.xxhash64(key), ["_base"])
    return out.withColumn(name, (F.col("_no") + F.col("_base")).cast("bigint")).drop("_slice", "_no", "_base")
