"""Evaluation metrics over prediction facts.

Facts: one row per prediction with pred, gold, answer_type and the subgroup
columns. Shares with an empty denominator are 0. All ties of "first seen" are
broken by an explicit position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import normalize_answer, squash, strip, text, token_f1, words

GENERIC_TOP = 30
DIMENSIONS = ["answer_type", "modality", "location", "q_lang", "content_type", "base_type"]


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def scored(facts: DataFrame) -> DataFrame:
    """Adds ok (exact match after normalization), is_open and f1."""
    return facts.withColumns({
        "ok": normalize_answer(F.col("pred")) == normalize_answer(F.col("gold")),
        "is_open": F.upper(text(F.col("answer_type"))) == "OPEN",
        "f1": token_f1(F.col("pred"), F.col("gold")),
    })


def exact_match(facts: DataFrame, by: Column) -> DataFrame:
    return scored(facts).groupBy(by.alias("key")).agg(F.count("*").alias("n"), F.count_if("ok").alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def overall(facts: DataFrame) -> DataFrame:
    """One row: closed accuracy, open mean F1 and their even mean."""
    got = scored(facts).agg(
        F.count_if(~F.col("is_open")).alias("closed_n"), F.count_if(~F.col("is_open") & F.col("ok")).alias("closed_ok"), F.count_if("is_open").alias("open_n"),
        F.sum(F.when(F.col("is_open"), F.col("f1"))).alias("f1_sum"), F.count("*").alias("n"), F.count_if("ok").alias("ok_n"),
    )
    closed, open_f1 = F.coalesce(F.try_divide("closed_ok", "closed_n"), F.lit(0.0)), F.coalesce(F.try_divide("f1_sum", "open_n"), F.lit(0.0))
    return got.select("n", ratio(F.col("ok_n"), F.col("n")).alias("accuracy"), F.round(closed, 6).alias("closed_accuracy"), F.round(open_f1, 6).alias("open_f1"), F.round(0.5 * closed + 0.5 * open_f1, 6).alias("overall_score"))


def subgroups(facts: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """(dim, value, n, accuracy, open_n, open_f1) of every value of every dimension; one pass, missing values as ''.

    The dimensions are unpivoted after a first aggregation, so the wide rows are read once and only counts are multiplied.
    """
    dims = dimensions or DIMENSIONS
    s = scored(facts).select(*[text(F.col(d)).alias(d) for d in dims], "ok", "is_open", "f1")
    cube = s.groupBy(*dims).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok_n"), F.count_if("is_open").alias("open_n"), F.sum(F.when(F.col("is_open"), F.col("f1"))).alias("f1_sum"))
    long = cube.unpivot(["n", "ok_n", "open_n", "f1_sum"], dims, "dim", "value")
    return long.groupBy("dim", "value").agg(F.sum("n").alias("n"), ratio(F.sum("ok_n"), F.sum("n")).alias("accuracy"), F.sum("open_n").alias("open_n"), ratio(F.coalesce(F.sum("f1_sum"), F.lit(0.0)), F.sum("open_n")).alias("open_f1"))


def distribution(records: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, value, n) of several columns; nulls as ''."""
    cells = records.select(*[text(F.col(c)).alias(c) for c in columns]).groupBy(*columns).agg(F.count("*").alias("n"))
    return cells.unpivot(["n"], columns, "dim", "value").groupBy("dim", "value").agg(F.sum("n").alias("n"))


def top_values(df: DataFrame, value: Column, position: str, k: int) -> DataFrame:
    """(value, n) of the k most frequent non-empty values; ties go to the value seen first."""
    got = df.select(value.alias("value"), F.col(position).alias("_at")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"), F.min("_at").alias("first_pos"))
    return got.orderBy(F.desc("n"), "first_pos").limit(k)


def open_summary(facts: DataFrame, generic: list[str]) -> DataFrame:
    """One row: open predictions, mean F1, exact match, generic rate and mean lengths."""
    s = scored(facts).filter("is_open")
    p = normalize_answer(F.col("pred"))
    return s.agg(
        F.count("*").alias("n"), ratio(F.sum("f1"), F.count("*")).alias("mean_f1"), ratio(F.count_if("ok"), F.count("*")).alias("exact_match"), ratio(F.count_if(p.isin(generic)), F.count("*")).alias("generic_rate"),
        ratio(F.sum(F.size(words(F.col("pred")))), F.count("*")).alias("mean_pred_words"), ratio(F.sum(F.length(strip(F.col("pred")))), F.count("*")).alias("mean_pred_chars"),
    )


def open_breakdown(facts: DataFrame, by: list[str], generic: list[str]) -> DataFrame:
    """(dim, value, n, generic_rate, token_f1) of open predictions."""
    s = scored(facts).filter("is_open").select(*[text(F.col(c)).alias(c) for c in by], "f1", normalize_answer(F.col("pred")).isin(generic).alias("generic"))
    cells = s.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("generic").alias("g"), F.sum("f1").alias("f"))
    return cells.unpivot(["n", "g", "f"], by, "dim", "value").groupBy("dim", "value").agg(F.sum("n").alias("n"), ratio(F.sum("g"), F.sum("n")).alias("generic_rate"), ratio(F.sum("f"), F.sum("n")).alias("token_f1"))


def invalid_excluded(facts: DataFrame) -> DataFrame:
    """Per key: all rows, invalid images, and accuracy over the valid ones only."""
    bad = F.coalesce("invalid_image", F.lit(False))
    return scored(facts).groupBy(F.upper(text(F.col("answer_type"))).alias("key")).agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid"), ratio(F.count_if(F.col("ok") & ~bad), F.count_if(~bad)).alias("accuracy"))


def confusion(facts: DataFrame) -> DataFrame:
    """One row of the four cells of yes/no golds; other golds are left out."""
    s = facts.select(normalize_answer(F.col("gold")).alias("g"), normalize_answer(F.col("pred")).alias("p")).filter("g in ('yes','no')")
    cell = lambda g, p: F.count_if((F.col("g") == g) & (F.col("p") == p))
    return s.agg(cell("yes", "yes").alias("yes_yes"), cell("yes", "no").alias("yes_no"), cell("no", "yes").alias("no_yes"), cell("no", "no").alias("no_no"), F.count("*").alias("yesno_total"))


def recall(facts: DataFrame) -> DataFrame:
    """One row: recall of yes and of no, with denominators of at least one."""
    c = confusion(facts)
    one = lambda hit, miss: F.round(F.col(hit) / F.greatest(F.lit(1), F.col(hit) + F.col(miss)), 6)
    return c.select(one("yes_yes", "yes_no").alias("recall_yes"), one("no_no", "no_yes").alias("recall_no"))


def margin_stats(facts: DataFrame, by: Column) -> DataFrame:
    """Mean, median and linear 90th percentile of margins per key; 0 where there is none."""
    return facts.groupBy(by.alias("key")).agg(
        F.count("margin").alias("n"), F.round(F.coalesce(F.avg("margin"), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.median("margin"), F.lit(0.0)), 6).alias("median"), F.round(F.coalesce(F.percentile("margin", 0.9), F.lit(0.0)), 6).alias("p90"),
    )


def tiny_margins(facts: DataFrame, limit: float = 0.05) -> DataFrame:
    """Share of yes/no rows with a margin under limit whose prediction is the majority one; yes wins a tie."""
    s = facts.select(normalize_answer(F.col("pred")).alias("p"), "margin").filter("p in ('yes','no') and margin is not null")
    c = s.agg(F.count_if(F.col("p") == "yes").alias("y"), F.count_if(F.col("p") == "no").alias("n"), F.count_if((F.col("margin") < limit) & (F.col("p") == "yes")).alias("ty"), F.count_if((F.col("margin") < limit) & (F.col("p") == "no")).alias("tn"))
    yes = F.col("y") >= F.col("n")
    return c.select(F.when(yes, "yes").otherwise("no").alias("majority"), (F.col("y") + F.col("n")).alias("rows"), ratio(F.when(yes, F.col("ty")).otherwise(F.col("tn")), F.col("y") + F.col("n")).alias("tiny_majority_rate"))


def variant_winner(facts: DataFrame, position: str) -> DataFrame:
    """(key, variant, n, share): the most frequent chosen variant per prediction; ties go to the first seen."""
    s = facts.select(normalize_answer(F.col("pred")).alias("key"), text(F.col("chosen_variant")).alias("variant"), F.col(position).alias("at")).filter("key <> '' and variant <> ''")
    per = s.groupBy("key", "variant").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = per.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", -F.col("at"), "variant")).alias("b"))
    return best.select("key", F.col("b.variant").alias("variant"), F.col("b.n").alias("n"), ratio(F.col("b.n"), F.col("all")).alias("share"))


def correlation(df: DataFrame, x: Column, y: Column) -> Column | DataFrame:
    """One row: n and Pearson's r, 0 for fewer than two rows or no variance."""
    s = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x is not null and y is not null")
    return s.agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), F.lit(0.0)), 6).alias("r"))


def ablation(facts: DataFrame, arm: Column, by: Column) -> DataFrame:
    """Per key: accuracy of both arms and the difference, arm being true or false."""
    s = scored(facts).select(by.alias("key"), arm.alias("arm"), "ok")
    acc = lambda on: F.coalesce(F.try_divide(F.count_if(on & F.col("ok")), F.count_if(on)), F.lit(0.0))
    got = s.groupBy("key").agg(acc(F.col("arm")).alias("w"), acc(~F.col("arm")).alias("wo"))
    return got.select("key", F.round("w", 6).alias("with_arm"), F.round("wo", 6).alias("without_arm"), F.round(F.col("w") - F.col("wo"), 6).alias("delta"))


def token_probability(df: DataFrame, by: list[str], logprob: str) -> DataFrame:
    """(by, n_tokens, score): mean log-probability per candidate."""
    return df.groupBy(*by).agg(F.count(logprob).alias("n_tokens"), F.round(F.coalesce(F.sum(logprob), F.lit(0.0)) / F.greatest(F.count(logprob), F.lit(1)), 6).alias("score"))


def log_softmax(scores: Column) -> Column:
    """Log-softmax of an array of scores."""
    top = F.array_max(scores)
    norm = F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return F.transform(scores, lambda x: x - norm)


def mean_words(x: Column) -> Column:
    return F.avg(F.size(words(squash(x))))


def route_losses(predictions: DataFrame, route: str, score: str) -> DataFrame:
    """(route, n, mean_loss, valid_ratio): mean negative log-probability of the chosen candidate, and the share of rows that have one."""
    return predictions.groupBy(route).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(-F.col(score)), F.lit(0.0)), 6).alias("mean_loss"), ratio(F.count(score), F.count("*")).alias("valid_ratio"))


def generation_gate(predictions: DataFrame, by: Column, generated: Column) -> DataFrame:
    """(key, n, mean_words, non_empty, passes): at most one generated text of a key may be empty."""
    some = F.count_if(strip(generated) != "")
    return predictions.groupBy(by.alias("key")).agg(F.count("*").alias("n"), F.round(mean_words(generated), 6).alias("mean_words"), some.alias("non_empty"), (some >= F.count("*") - 1).alias("passes"))


def mean_of_texts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean) of texts that write numbers; others don't count."""
    v = F.expr(f"try_cast({value} as double)")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias("mean"))
