"""Worker registry in batch form: latest state, expiry, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(beats: DataFrame, worker: str, at: str, columns: list[str], ties: str) -> DataFrame:
    """(worker, last_seen, columns) of the last heartbeat of each worker."""
    got = beats.groupBy(worker).agg(F.max(F.struct(F.col(at), F.col(ties))).alias("_k"), F.max_by(F.struct(*columns), F.struct(at, ties)).alias("_r"))
    return got.select(worker, F.col(f"_k.{at}").alias("last_seen"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def alive(state: DataFrame, now: Column, ttl_seconds: int, checked: Column | None = None) -> DataFrame:
    """Workers whose last heartbeat isn't older than the time to live, or that need none."""
    fresh = F.col("last_seen") >= now - F.make_interval(secs=F.lit(ttl_seconds))
    return state.filter(fresh | ~checked if checked is not None else fresh)


def sessions(beats: DataFrame, worker: str, at: str, ttl_seconds: int) -> DataFrame:
    """(worker, session_no, first_seen, last_seen, beats): a gap above the time to live ends a session."""
    w = Window.partitionBy(worker).orderBy(at)
    gap = F.col(at) > F.lag(at).over(w) + F.make_interval(secs=F.lit(ttl_seconds))
    d = beats.select(worker, at, F.when(gap, 1).otherwise(0).alias("_new"))
    d = d.withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(worker, "session_no").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("beats"))


def shortest_queue(state: DataFrame, models: str, worker: str, queue: str, speed: str) -> DataFrame:
    """(model, worker, load): per model the worker with the least queue by speed; ties go to the first name."""
    return state.filter(F.col(speed) > 0).withColumn("load", F.col(queue) / F.col(speed)).groupBy(models).agg(F.min(F.struct("load", worker)).alias("b")).select(models, F.col(f"b.{worker}").alias(worker), F.round("b.load", 6).alias("load"))


def fleet(state: DataFrame, models: str, queue: str, speed: str) -> DataFrame:
    """One row: distinct models, speed and queue of all workers."""
    return state.agg(F.count_distinct(models).alias("models"), F.sum(speed).alias("speed"), F.sum(queue).alias("queue_length"))


def by_priority(names: DataFrame, name: str, priority: dict[str, str]) -> DataFrame:
    """Names in the order of their priority key, or of themselves."""
    key = F.col(name)
    for n, k in priority.items():
        key = F.when(F.col(name) == n, k).otherwise(key)
    return names.orderBy(key, name)


def refresh(state: DataFrame, polls: DataFrame, worker: str, ok: str, columns: list[str]) -> DataFrame:
    """The state of the workers that answered a poll, with the columns they answered; the others are dropped."""
    fresh = polls.filter(ok).select(worker, *[F.col(c).alias(f"_{c}") for c in columns])
    return state.join(fresh, worker).select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in state.columns])
