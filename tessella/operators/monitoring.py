"""Run monitoring: batch statistics, histograms, throughput, parameter tallies, metric events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_stats(df: DataFrame, by: list[str], length: Column, limit: int, is_open: Column) -> DataFrame:
    """Per batch: rows, mean and largest length, tokens, truncated share, open share."""
    return df.select(*by, length.alias("len"), is_open.alias("open")).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("mean_len"), F.max("len").alias("max_len"), F.sum(F.least("len", F.lit(limit))).alias("tokens"), F.round(F.avg((F.col("len") > limit).cast("int")), 6).alias("truncated"), F.round(F.avg(F.col("open").cast("int")), 6).alias("open_ratio"),
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from 1; 0 below low, bins + 1 from high on."""
    return df.filter(F.col(value).isNotNull()).select(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def throughput(events: DataFrame, by: list[str], seconds: Column, amount: Column, interval: int) -> DataFrame:
    """(by, slot, amount, per_second): amounts per interval; the rate is over the time since the series' last slot."""
    slot = F.floor(seconds / interval).cast("bigint")
    s = events.groupBy(*by, slot.alias("slot")).agg(F.sum(amount).alias("amount"))
    gap = (F.col("slot") - F.lag("slot").over(Window.partitionBy(*by).orderBy("slot"))) * interval
    return s.select(*by, "slot", F.round("amount", 6).alias("amount"), F.round(F.try_divide("amount", gap), 6).alias("per_second"))


def every(step: Column, n: int) -> Column:
    return (step % n) == 0


def parameter_tally(params: DataFrame, name: str, numel: str, trainable: Column) -> DataFrame:
    """(prefix, n, total, trainable): numbers of parameters by the first part of their name."""
    return params.groupBy(F.split_part(F.col(name), F.lit("."), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"), F.sum(numel).alias("total"), F.sum(F.when(trainable, F.col(numel)).otherwise(0)).alias("trainable"))


def component_of(name: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The first rule (token, component) whose token the name holds."""
    out = F.lit(default)
    for token, component in reversed(rules):
        out = F.when(F.contains(name, F.lit(token)), component).otherwise(out)
    return out


def l2_norms(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.sqrt(F.sum(F.col(value) * F.col(value))), 6).alias("norm"))


def clean_scalars(events: DataFrame, value: str) -> DataFrame:
    """Metric events with a finite number; texts are parsed, the rest is dropped."""
    v = F.expr(f"try_cast({value} as double)")
    return events.withColumn(value, v).filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))


def run_counters(predictions: DataFrame) -> DataFrame:
    """One row of counters: empty raw and extracted texts, image-index answers, invalid images, rows."""
    from tessella.functions.text import is_image_index, strip

    return predictions.agg(
        F.count("*").alias("n"), F.count_if(strip(F.col("raw_generation")) == "").alias("empty_raw"), F.count_if(strip(F.col("extracted_pred")) == "").alias("empty_extracted"), F.count_if(is_image_index(F.col("extracted_pred"))).alias("image_index"), F.count_if(F.coalesce("invalid_image", F.lit(False))).alias("invalid_images"),
    )


def token_histogram(df: DataFrame, generated: Column) -> DataFrame:
    """(place, token, n): how often each word is the first and the last of a generated text; '' where there is none."""
    from tessella.functions.text import squash, words

    w = words(squash(generated))
    ends = F.array(F.struct(F.lit("first").alias("place"), F.coalesce(F.get(w, 0), F.lit("")).alias("token")), F.struct(F.lit("last").alias("place"), F.coalesce(F.get(w, F.size(w) - 1), F.lit("")).alias("token")))
    return df.select(F.inline(ends)).groupBy("place", "token").agg(F.count("*").alias("n"))


def retries(predictions: DataFrame, by: Column) -> DataFrame:
    """(key, n, retries): predictions that a run asks for again, those without an extracted text on a valid image."""
    from tessella.functions.text import strip

    again = (strip(F.col("extracted_pred")) == "") & ~F.coalesce("invalid_image", F.lit(False))
    return predictions.groupBy(by.alias("key")).agg(F.count("*").alias("n"), F.count_if(again).alias("retries"))
