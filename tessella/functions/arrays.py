"""Token sequences and chunks as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE, IMAGE_INDEX = -100, -200


def char_tokens(x: Column) -> Column:
    """A stand-in tokenizer: one id per character, its code point modulo 100, plus 2."""
    chars = F.filter(F.split(F.coalesce(x, F.lit("")), ""), lambda c: c != "")
    return F.transform(chars, lambda c: (F.ascii(c) % 100 + 2).cast("int"))


def label_mask(prompt_ids: Column, answer_ids: Column, max_prompt: int = 512, max_answer: int = 64) -> Column:
    """struct of input_ids, labels (prompt masked), attention_mask, lengths and truncation flags."""
    p, a = F.slice(prompt_ids, 1, max_prompt), F.slice(answer_ids, 1, max_answer)
    n = F.size(p) + F.size(a)
    return F.struct(
        F.concat(p, a).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(p)), a).alias("labels"), F.array_repeat(F.lit(1), n).alias("attention_mask"),
        F.size(p).alias("prompt_length"), F.size(a).alias("answer_length"), (F.size(prompt_ids) > max_prompt).alias("prompt_truncated"), (F.size(answer_ids) > max_answer).alias("answer_truncated"),
    )


def pad_right(ids: Column, to: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(to - F.size(ids), F.lit(0))))


def pad_left(ids: Column, to: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(to - F.size(ids), F.lit(0))), ids)


def attention_left(ids: Column, to: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.greatest(to - F.size(ids), F.lit(0))), F.array_repeat(F.lit(1), F.size(ids)))


def generated_suffix(ids: Column, input_len: Column) -> Column:
    return F.slice(ids, input_len + 1, F.greatest(F.size(ids) - input_len, F.lit(0)))


def image_token_ids(prompt: Column, tokenize, bos: int) -> Column:
    """Ids of the parts around <image>, joined by IMAGE_INDEX, with one leading bos."""
    parts = F.split(prompt, "<image>")
    ids = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(IMAGE_INDEX))).otherwise(F.array().cast("array<int>")), tokenize(p)))
    return F.concat(F.array(F.lit(bos)), F.flatten(ids))


def banned_first_ids(variants: Column, tokenize) -> Column:
    """Sorted distinct first ids of banned variants."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(variants, lambda v: F.get(tokenize(v), 0)), lambda x: x.isNotNull())))


def banned_sequences(variants: Column, tokenize) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(variants, tokenize), lambda x: F.size(x) > 0)))


def sliding_slices(arr: Column, n: int, overlap: int = 10) -> Column:
    """Slices of n + overlap items, one every n items."""
    starts = F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(arr, i + 1, n + overlap))


def tail_chunk(i: Column, total: Column, n: int) -> Column:
    """Chunk of item i of total: chunks of n, a tail under half a chunk joins the last."""
    return F.least(F.floor(i / F.lit(n)), F.greatest(F.lit(0), F.ceil(total / F.lit(n) - F.lit(1.5)))).cast("int")


def nested_sum(arr: Column) -> Column:
    """Sum of an array of arrays of numbers."""
    return F.aggregate(F.flatten(arr), F.lit(0.0), lambda s, x: s + x)


def even_chunks(rank: Column, total: Column, chunks: int) -> Column:
    """Chunk of the rank-th of total rows, from 0, in chunks of ceil(total / chunks)."""
    return F.floor(rank / F.ceil(total / F.lit(chunks))).cast("int")


def aspect_size(width: Column, height: Column, long: int = 800, short: int = 400) -> Column:
    """struct(width, height) of an image scaled so that its longer side is within bounds set by its aspect ratio."""
    big, small = F.greatest(width, height), F.least(width, height)
    shortest = F.least(F.floor(F.lit(long) / (big / small)), F.lit(short), small)
    longest = F.floor(shortest * (big / small))
    wide = width >= height
    return F.struct(F.when(wide, longest).otherwise(shortest).cast("int").alias("width"), F.when(wide, shortest).otherwise(longest).cast("int").alias("height"))


def square_padding(width: Column, height: Column) -> Column:
    """struct(side, left, top) that centres an image on a square."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).cast("int").alias("left"), F.floor((side - height) / 2).cast("int").alias("top"))
