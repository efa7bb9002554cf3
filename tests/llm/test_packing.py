"""Containers: nothing lost, nothing overfull, nothing divided without need; buckets against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import packing as P


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        d = rng.randint(3, 9)
        lengths = sorted(rng.sample(range(1, 60), d))
        counts = [rng.randint(1, 20) for _ in lengths]
        for k in (1, 2, 3):
            got = P.bucket_bounds(np.array(lengths), np.array(counts), k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, d)) for c in itertools.combinations(lengths[:-1], n))
            assert len(got) <= k and padding(lengths, counts, got) == best


def test_plan_is_whole():
    rng = random.Random(2)
    hist = {rng.randint(1, 512): rng.randint(1, 300) for _ in range(200)}
    runs, bound_of, n = P.plan(hist, 512)
    for x, c in hist.items():
        covered = sorted((a, b) for y, a, b, _, _ in runs if y == x)
        assert covered[0][0] == 0 and covered[-1][1] == c and all(p[1] == q[0] for p, q in zip(covered, covered[1:])) and bound_of[x] >= x
    assert n >= sum(x * c for x, c in hist.items()) / 512
    assert P.plan({}, 10) == ([], {}, 0)


def test_pack(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 0, 3, 7, 50, 99, 100, 101, 250, rng.randint(1, 100)])) for k in range(1, 600)] + [(k, 33) for k in range(1000, 1400)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("len", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = P.pack(df, 100)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {k for k, _ in rows}
    for k, n in rows:
        parts = sorted(by[k], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in parts) == n and len(parts) == max(1, -(-n // 100)) and [r.start_pos for r in parts] == [100 * i for i in range(len(parts))]
    full = {r.container_id: r.t for r in got.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).collect()}
    assert max(full.values()) <= 100 and None not in full
    total = sum(n for _, n in rows)
    assert total / (100 * max(full)) > 0.97
    assert P.pack(df, 100).orderBy("doc_id", "piece_no").collect() == got.orderBy("doc_id", "piece_no").collect()


def test_buckets_take_part():
    rng = random.Random(7)
    hist = {x: rng.randint(1, 400) for x in range(3, 480)}
    plans = {k: P.plan(hist, 512, k) for k in (1, 4, 16, 32)}
    runs = [sorted(p[0]) for p in plans.values()]
    assert all(a != b for a, b in itertools.combinations(runs, 2))
    tokens = sum(x * c for x, c in hist.items())
    assert tokens / (512 * plans[32][2]) > 0.98 > 0.5 > tokens / (512 * plans[1][2])
    # the first piece of every container is of the longest bucket in it, and a bucket's own pieces fit its padded slots
    runs, bound_of, _ = plans[32]
    own: dict[tuple[int, int], int] = {}
    for x, a, b, c, m in runs:
        own[c, bound_of[x]] = own.get((c, bound_of[x]), 0) + m
    longest = {}
    for (c, bound), n in own.items():
        longest[c] = max(longest.get(c, 0), bound)
    assert all(own[c, bound] <= max(1, 512 // bound) for c, bound in longest.items())


def test_waste_on_whole_tables(spark):
    from tessella.llm import queries as Q

    got = {r.budget_id: r.fill for r in Q.p8_fill(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 3 and min(got.values()) > 0.98


def test_nulls_and_empty_items_ride_along(spark):
    df = spark.createDataFrame([(k, None if k % 3 else 0) for k in range(200)] + [(1000 + k, 60) for k in range(10)], "doc_id bigint, n_tokens bigint")
    got = P.pack(df, 100).collect()
    assert len(got) == 210 and {r.container_id for r in got} == set(range(1, 11))
    only = P.pack(df.filter("doc_id < 1000"), 100).collect()
    assert len(only) == 200 and {r.container_id for r in only} == {1}


def test_limits(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert P.pack(none, 10).count() == 0
    with pytest.raises(ValueError):
        P.pack(none, 0)
    budgets = spark.createDataFrame([(1, 10), (2, 4)], "budget_id int, capacity int")
    got = P.fill(P.pack_budgets(spark.createDataFrame([(1, 8), (2, 2), (3, 4)], "doc_id bigint, n_tokens bigint"), budgets), budgets)
    assert {r.budget_id: r.containers for r in got.collect()} == {1: 2, 2: 4}
