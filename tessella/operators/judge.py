"""Judge reviews: score parsing and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import judge_scores

DOMAINS = ["chest_xray", "mri", "histology", "gross", "ct_scan"]


def first_domain(flags: Column, domains: list[str] | None = None) -> Column:
    """Name of the first true flag of a struct; null if none is."""
    return F.coalesce(*[F.when(flags[d], d) for d in domains or DOMAINS])


def summary(reviews: DataFrame, kind: str, domain: str, review: str) -> DataFrame:
    """(grp, n, score1, score2, relative): each review counts for its kind, 'overall' and its domain; relative is the mean of the rows' ratios in percent."""
    s = reviews.withColumn("_s", judge_scores(F.col(review))).filter("_s is not null")
    g = s.select(F.explode(F.filter(F.array(F.col(kind), F.lit("overall"), F.col(domain)), lambda x: x.isNotNull())).alias("grp"), F.col("_s")[0].alias("a"), F.col("_s")[1].alias("b"))
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("score1"), F.round(F.avg("b"), 6).alias("score2"), F.round(F.coalesce(F.avg(F.try_divide("b", "a")), F.lit(0.0)) * 100, 6).alias("relative"))
