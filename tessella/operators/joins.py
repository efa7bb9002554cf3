"""Keyed, positional and patch joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.ordinals import with_ordinal


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; an aggregation, so it combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def probe_join(probe: DataFrame, build: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Probe rows with the last build row of their key; misses are dropped."""
    return probe.join(latest(build.select(key, *dict.fromkeys(order + columns)), key, order).select(key, *columns), key)


def positional_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Row i of left beside row i of right, by explicit keys; as many rows as the shorter side."""
    a, b = with_ordinal(left, left_key, "pos"), with_ordinal(right, right_key, "pos")
    return a.join(b, "pos")


def patch(base: DataFrame, retry: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of retry where it has the key and a value."""
    r = retry.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(r, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def owned_variants(labels: DataFrame, by: str, labels_col: str, variants: Column) -> DataFrame:
    """(by, base_pos, base, variant) of array labels_col; a variant belongs to the first base that has it."""
    long = labels.select(by, F.posexplode(labels_col).alias("base_pos", "base")).select(by, "base_pos", "base", F.posexplode(variants).alias("var_pos", "variant"))
    own = long.groupBy(by, "variant").agg(F.min(F.struct("base_pos", "var_pos", "base")).alias("o"))
    return own.select(by, F.col("o.base_pos").alias("base_pos"), F.col("o.base").alias("base"), "variant")


def gather(rows: DataFrame, owners: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with columns of their owner, by its key; rows without an owner are dropped."""
    return rows.join(owners.select(key, *columns), key)
