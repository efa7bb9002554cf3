"""Ranking, windows, batching and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.ordinals import with_ordinal

#: Items of a ring that is numbered in one task and broadcast; a larger one is numbered in slices and joined.
RING_ITEMS = 100_000


def best_second(scores: DataFrame, by: list[str], label: str, score: str, position: str) -> DataFrame:
    """(by, best_label, best_score, second_score, margin) of candidates; ties go to the earlier position, one candidate is its own second.

    Ranks up to two are kept on both sides of the shuffle, so a group of any size reaches its task as two rows of each.
    """
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_s"), F.asc("_p"), F.desc("_l")))
    top = scores.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("_s"), F.col(position).alias("_p"), F.col(label).alias("_l")).withColumn("_rn", rn).filter(F.col("_rn") <= 2)
    two = top.groupBy(*by).agg(F.max(F.when(F.col("_rn") == 1, F.struct("_s", "_l"))).alias("b"), F.max(F.when(F.col("_rn") == 2, F.col("_s"))).alias("s2"))
    second = F.coalesce("s2", F.col("b._s"))
    return two.select(*by, F.col("b._l").alias("best_label"), F.round("b._s", 6).alias("best_score"), F.round(second, 6).alias("second_score"), F.round(F.col("b._s") - second, 6).alias("margin"))


def variant_max(scores: DataFrame, by: list[str], variant: str, score: str, position: str) -> DataFrame:
    """(by, variant, score): the best variant of each base, the first of equals."""
    got = scores.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(position)).alias("p"), F.col(variant).alias("v"))).alias("b"))
    return got.select(*by, F.col("b.v").alias("variant"), F.round("b.s", 6).alias("score"))


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= n)


def chunks(df: DataFrame, key: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """Adds chunk: n contiguous parts in the order of key, each of ceil(rows / n) rows."""
    total = df.count()
    size = max(1, -(-total // n))
    return with_ordinal(df, key, "ordinal", ties).withColumn("chunk", F.floor(F.col("ordinal") / size).cast("int"))


def representatives(df: DataFrame, key: str, ties: list[str] | None = None) -> DataFrame:
    """The rows at 0, a third, a half and the end of the order, each once."""
    n = df.count()
    at = sorted({0, n // 3, n // 2, n - 1}) if n else []
    return with_ordinal(df, key, "ordinal", ties).filter(F.col("ordinal").isin(at))


def run_batches(df: DataFrame, within: list[str], order: list[str], is_open: Column, budget: Column, size: int) -> DataFrame:
    """Adds batch_no: runs of consecutive open rows of one budget, cut at size, broken by any other row; other rows have none."""
    w = Window.partitionBy(*within).orderBy(*order)
    d = df.withColumns({"_open": is_open, "_budget": F.when(is_open, budget)})
    d = d.withColumn("_new", F.when(F.col("_open") & (~F.coalesce(F.lag("_open").over(w), F.lit(False)) | ~F.col("_budget").eqNullSafe(F.lag("_budget").over(w))), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*within, "_run", "_open").orderBy(*order)
    d = d.withColumn("_in", F.when(F.col("_open"), F.floor((F.row_number().over(inside) - 1) / size)))
    return d.select(*df.columns, F.when(F.col("_open"), F.col("_run")).alias("run_no"), F.col("_in").cast("bigint").alias("batch_in_run"), F.when(F.col("_open"), F.col("_budget")).alias("budget"))


def stratified_probe(df: DataFrame, strata: list[str], key: Column, size: int, seed: int) -> DataFrame:
    """size rows, dealt round-robin over the strata in a seeded order; all rows if there are no more."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    g = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]))
    # no stratum gives more than size rows, so only those are ranked globally
    ranked = df.withColumns({"_h": h, "_g": g}).withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_h"))).filter(F.col("_rn") <= size)
    return ranked.orderBy("_rn", "_g").limit(size).drop("_h", "_g", "_rn")


def seeded_sample(df: DataFrame, key: Column, size: int, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))).limit(size)


def balanced_sample(df: DataFrame, is_open: Column, key: Column, size: int, seed: int) -> DataFrame:
    """Half open, half closed rows in a seeded order, filled up from the rest where one side is short."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    d = df.withColumns({"_o": is_open, "_h": h})
    top = d.withColumn("_rn", F.row_number().over(Window.partitionBy("_o").orderBy("_h"))).filter(F.col("_rn") <= size)
    quota = F.when(F.col("_o"), size - size // 2).otherwise(size // 2)
    return top.orderBy((F.col("_rn") > quota).cast("int"), "_h").limit(size).drop("_o", "_h", "_rn")


def seeded_negatives(keys: DataFrame, key: str, gold: str, vocabulary: DataFrame, k: int, seed: int) -> DataFrame:
    """(key, item, rank): k items of a vocabulary other than the gold; all of them if there are no more.

    The items stand on a ring in a seeded order; a key starts at a place of its
    hash and takes the next ones. So a key asks for k + 1 places, whatever the
    vocabulary's size, and those are joined, not compared with every item.
    """
    mark = lambda x: F.md5(F.concat_ws(":", F.lit(str(seed)), x.cast("string")))
    items = vocabulary.select("item").distinct()
    n = items.count()
    if not n:
        return keys.select(key, F.lit(None).cast("string").alias("item"), F.lit(None).cast("int").alias("rank")).limit(0)
    if n <= RING_ITEMS:  # a small ring is numbered at once
        ring = items.select("item", (F.row_number().over(Window.orderBy(mark(F.col("item")), "item")) - 1).cast("bigint").alias("_at"))
    else:
        placed = items.withColumn("_place", F.conv(F.substring(mark(F.col("item")), 1, 13), 16, 10).cast("double"))
        ring = with_ordinal(placed, "_place", "_at", [mark(F.col("item")), "item"]).select("item", F.col("_at").cast("bigint").alias("_at"))
    start = F.conv(F.substring(mark(F.col(key)), 1, 8), 16, 10).cast("bigint")
    steps = F.array(*[F.lit(i) for i in range(min(n, k + 1))])
    asked = keys.select(key, gold, start.alias("_h"), F.explode(steps).alias("_k")).withColumn("_at", F.pmod(F.col("_h") + F.col("_k"), F.lit(n)))
    got = asked.join(F.broadcast(ring) if n <= RING_ITEMS else ring, "_at").filter(~F.col("item").eqNullSafe(F.col(gold)))
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_k")))
    return got.filter(F.col("rank") <= k).select(key, "item", "rank")


def vocab_overlap(questions: DataFrame, key: str, tokens: str, vocabulary: DataFrame, k: int) -> DataFrame:
    """(key, answer, overlap, rank): the k vocabulary answers that share most distinct tokens with the question, ties by answer.

    An equi-join on tokens counts overlaps; answers without any are added back, in their order, only as far as places are left.
    """
    q = questions.select(key, F.explode(F.array_distinct(F.col(tokens))).alias("t"))
    v = vocabulary.select("answer", F.explode(F.array_distinct(F.col("tokens"))).alias("t"))
    hit = q.join(v, "t").groupBy(key, "answer").agg(F.count("*").alias("overlap"))
    top = hit.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("overlap"), "answer"))).filter(F.col("rank") <= k)
    first = [r["answer"] for r in vocabulary.select("answer").distinct().orderBy("answer").limit(2 * k).collect()]  # 2 * k rows
    rest = F.array(*[F.lit(a) for a in first]).cast("array<string>")
    per = questions.select(key).join(top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "answer", "overlap"))).alias("got")), key, "left")
    got = F.coalesce("got", F.array().cast("array<struct<rank:int,answer:string,overlap:bigint>>"))
    have = F.transform(got, lambda g: g["answer"])
    more = F.transform(F.filter(rest, lambda a: ~F.array_contains(have, a)), lambda a: F.struct(F.lit(0).alias("rank"), a.alias("answer"), F.lit(0).cast("bigint").alias("overlap")))
    full = F.slice(F.concat(got, more), 1, k)
    return per.select(key, F.posexplode(full).alias("p", "g")).select(key, F.col("g.answer").alias("answer"), F.col("g.overlap").alias("overlap"), (F.col("p") + 1).alias("rank"))


def weighted_lottery(df: DataFrame, weight: str, key: Column, seed: int) -> DataFrame:
    """One row drawn with probability by weight; rows of no weight never win."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    return df.filter(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight)).limit(1)
