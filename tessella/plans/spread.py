"""Equi-joins that survive a few very hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.cut import kept, measure

#: A key with this share of the rows is spread over salts; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 64
SALTS = 32
#: A right side of up to so many rows and bytes is broadcast; both are measured first, on the written side.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 64 << 20


def _few(right: DataFrame, rows: int, size: int) -> bool:
    n, width = measure(right)
    return n <= rows and width <= size


def _named(x: str | tuple[str, str]) -> tuple[str, str]:
    return (x, x) if isinstance(x, str) else x


def spread_join(left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], count: str | None, salt_by: Column, columns: list[str | tuple[str, str]], how: str = "inner", least: int = 1000, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Joins left to right on null-safe equal columns ``on``: names, or pairs of a left and a right name.

    A right side that isn't a written table is written first, as it is read more
    than once. If it is small by measure it is broadcast. Otherwise keys that hold
    HOT_SHARE of the left rows are spread over SALTS by ``salt_by`` and their right
    rows are repeated once per salt; they are proven to be at most 1 / HOT_SHARE.
    ``count`` names the right column with the number of left rows of a key, right
    having one row per key; with None the left rows are counted, and right may have
    many rows per key. Result: left's columns, then columns (names, or pairs of a
    right and a new name).
    """
    on, columns = [_named(x) for x in on], [_named(x) for x in columns]
    if not hasattr(right, "_tessella_path"):
        right = kept(right.select(*dict.fromkeys([*[r for _, r in on], *([count] if count else []), *[c for c, _ in columns]])), "side")
    keys = [f"_k{i}" for i in range(len(on))]
    cond = F.lit(True)
    for (c, _), n in zip(on, keys):
        cond = cond & F.col(c).eqNullSafe(F.col(n))
    side = [*[F.col(r).alias(n) for (_, r), n in zip(on, keys)], *[F.col(c).alias(n) for c, n in columns]]
    if broadcast_rows and _few(right, broadcast_rows, broadcast_bytes):
        return left.join(F.broadcast(right.select(*side)), cond, how).drop(*keys)
    if count:
        counts = right.select(*[F.col(r).alias(n) for (_, r), n in zip(on, keys)], F.col(count).alias("_n"))
        total = counts.agg(F.sum("_n")).first()[0] or 0
    else:
        counts = kept(left.groupBy(*[F.col(c).alias(n) for (c, _), n in zip(on, keys)]).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least), "counts")
        total = left.count()
    hot = counts.filter(F.col("_n") >= max(least, total * HOT_SHARE)).select(*keys).collect()
    types = dict(counts.dtypes)

    def is_hot(names: list[str]) -> Column:
        got = F.lit(False)
        for row in hot:
            same = F.lit(True)
            for c, n in zip(names, keys):
                same = same & F.col(c).eqNullSafe(F.lit(row[n]).cast(types[n]))
            got = got | same
        return got

    a = left.withColumn("_salt", F.when(is_hot([c for c, _ in on]), F.pmod(salt_by, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    salts = F.when(is_hot(keys), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.select(*side).withColumn("_s", F.explode(salts))
    return a.join(b, cond & (F.col("_salt") == F.col("_s")), how).drop("_salt", "_s", *keys)


def when_few(right: DataFrame, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written right side of a join, marked for broadcast if it is measured to be small enough."""
    return F.broadcast(right) if broadcast_rows and _few(right, broadcast_rows, broadcast_bytes) else right

