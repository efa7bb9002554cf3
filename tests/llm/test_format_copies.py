"""Copies against a dictionary of canonical records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import format_copies as C
from tessella.plans.cut import Scratch

BASE = {"img_id": 1, "img_name": "a/b", "question": "Is it 14.5 mm wide?", "answer": "Größe: JA", "q_lang": "en", "triple": ["vhead", "_", "_"]}


def payload(**k):
    return json.dumps({**BASE, **k}, ensure_ascii=k.get("ascii", True))


ROWS = [
    (5, payload()), (3, json.dumps(dict(reversed(BASE.items())), ensure_ascii=False, indent=1)), (9, payload(question="  is IT 14.5 mm\twide", answer="grösse ja!")), (10, payload(question="Is it 145 mm wide?")), (11, payload(question="Is it 14,5 mm wide?")),
    (12, payload(q_lang="EN")), (13, payload(answer=None)), (14, payload(answer="")), (15, None), (16, None), (17, "not json"), (18, "not json"), (19, payload(answer="GRÖSSE_JA")),
]


def test_pairs(spark):
    df = spark.createDataFrame(ROWS, "raw_id bigint, payload string").withColumn("canon", F.lit(1)).withColumn("h", F.lit(2))
    got = sorted((r.raw_id_a, r.raw_id_b) for r in C.found(df).collect())
    assert got == [(3, 5), (3, 9), (3, 19), (17, 18)]
    n = {r.raw_id: r.copies for r in C.collapsed(df).collect()}
    assert sum(n.values()) == len(ROWS) and n[3] == 4 and n[15] == 1 and n[13] == 1


@pytest.mark.parametrize("size", [1 << 30, 0])
def test_filters_lose_no_repeat(spark, size):
    df = spark.range(150_000).select(F.col("id").alias("raw_id"), F.when(F.col("id") < 50_000, F.lit("hot")).otherwise((F.col("id") % 75_000).cast("string")).alias("canon")).repartition(7)
    want = df.groupBy("canon").count().filter("count > 1").agg(F.sum("count")).first()[0]
    maybe, single = C.possible_repeats(df, 150_000, Scratch(spark, "t"), size)
    assert maybe.count() + single.count() == 150_000
    again = maybe.groupBy("canon").count().filter("count > 1")
    assert again.agg(F.sum("count")).first()[0] == want and single.groupBy("canon").count().filter("count > 1").count() == 0
    # singletons are proven: nearly all of them stay out of the exact grouping
    assert single.count() > 0.97 * (150_000 - want)


@pytest.mark.parametrize("n", [10, 60_000])
def test_sparse_and_dense_parts_give_the_same_bits(n):
    h = np.random.default_rng(3).integers(-(2**62), 2**62, n)
    at = C._probe(h, 1)[1]
    assert C._pack(h, at)[:1] == (b"h" if n == 10 else b"b")
    bits = np.zeros(C.SHARD_BITS, bool)
    bits[at.ravel()] = True
    assert (C._unpack(C._pack(h, at), 1) == bits).all()


def test_blocks_give_what_one_filter_gives(spark, data):
    raw = spark.read.parquet(f"{data}/raw_record.parquet")
    many = raw.crossJoin(spark.range(400).select(F.col("id").alias("k"))).select((F.col("raw_id") * 400 + F.col("k")).alias("raw_id"), F.concat(F.lit('{"k":'), F.col("k"), F.lit(","), F.substring("payload", 2, 100_000)).alias("payload"))
    one, blocks = C.found(many), C.found(many, broadcast_bytes=0)
    assert one.exceptAll(blocks).isEmpty() and blocks.exceptAll(one).isEmpty() and one.count() == 400 * C.found(raw).count()


def test_empty(spark):
    none = spark.createDataFrame([], "raw_id bigint, payload string")
    for size in (1 << 30, 0):
        assert C.found(none, broadcast_bytes=size).count() == 0 and C.collapsed(none, broadcast_bytes=size).count() == 0
