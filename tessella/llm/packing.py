"""Filling fixed-capacity containers with items.

Items larger than the capacity are cut into full containers and a rest; nothing
else is divided. The exact global histogram of piece lengths (at most one entry
per length up to the capacity) goes to the driver, where dynamic programming
chooses the length buckets of least padding. Token-budget batches form inside
each bucket, longest bucket first: as many pieces as fit the capacity if each
is counted with its bucket's upper length. A second step tops up the space that
a batch really leaves, with the longest pieces of shorter buckets that fit; it
is there because batches alone leave the padding and the remainder unused. The
plan is a list of runs, "pieces of this length number a to b go to containers
from c on, k in each", and pieces find their container by their number, so no
task ever sees more than its own pieces. All budgets are planned and packed in
one pass.

Defined cases: items of no length, and null lengths, take no space and are spread
over the containers (the first, if there is no other); an empty table gives an
empty result; a capacity below 1 is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length buckets of a plan.
BUCKETS = 32
#: Slices in which pieces of one length are numbered, at least, and pieces of one length and slice, about, at most.
SLICES, PER_SLICE = 64, 500_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, k: int = BUCKETS) -> list[int]:
    """Upper bounds of at most k buckets with the least total padding of lengths to their bound; lengths ascend.

    cost(i, j) pads lengths i..j-1 to the last of them. The best start of the
    last bucket never moves left as j grows, so each layer is solved by halving.
    """
    d = len(lengths)
    if d <= k:
        return [int(x) for x in lengths]
    n = np.r_[0, np.cumsum(counts, dtype=np.float64)]
    t = np.r_[0, np.cumsum(counts * lengths, dtype=np.float64)]
    ends = np.r_[0, lengths].astype(np.float64)
    best = ends * n - t  # one bucket
    cuts = []
    for _ in range(1, k):
        nxt, cut = best.copy(), np.zeros(d + 1, np.int64)
        todo = [(1, d, 0, d)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + ends[j] * (n[j] - n[i]) - (t[j] - t[i])
            at = int(np.argmin(cost))
            nxt[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        cuts.append(cut)
        best = nxt
    bounds, j = [], d
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(set(bounds))


def plan(hist: dict[int, int], capacity: int, k: int = BUCKETS) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], int]:
    """Runs (length, first, last, container, per_container), the bucket bound of each length, and the number of containers.

    A run sends the pieces of one length numbered first..last-1 to containers
    from ``container`` on, per_container in each.
    """
    lengths = np.array(sorted(x for x in hist if x > 0), np.int64)
    if not len(lengths):
        return [], {}, 0
    bounds = bucket_bounds(lengths, np.array([hist[int(x)] for x in lengths], np.int64), k)
    bound_of = {int(x): bounds[int(np.searchsorted(bounds, x))] for x in lengths}
    left = np.array([hist[int(x)] for x in lengths], np.int64)
    used = np.zeros(len(lengths), np.int64)
    runs, container = [], 0
    ends = np.searchsorted(lengths, bounds, side="right")  # positions of bucket i are ends[i - 1] to ends[i]
    for i in range(len(bounds) - 1, -1, -1):
        inside = [p for p in range(int(ends[i - 1]) if i else 0, int(ends[i])) if left[p]]
        shorter = [p for p in range(int(ends[i - 1]) if i else 0) if left[p]]
        slots = max(1, capacity // bounds[i])
        while inside:
            # the batch: pieces of this bucket, longest first, one in each padded slot
            take, places = [], slots
            for p in reversed(inside):
                n = int(min(places, left[p]))
                take.append((p, n))
                places -= n
                if not places:
                    break
            # the second step: what the batch really leaves
            space = capacity - sum(n * int(lengths[p]) for p, n in take)
            hi = len(shorter)
            while hi and space >= lengths[shorter[0]]:
                at = _last_fit(lengths, shorter, hi, space)
                if at < 0:
                    break
                p = shorter[at]
                n = int(min(space // lengths[p], left[p]))
                take.append((p, n))
                space -= n * int(lengths[p])
                hi = at
            times = int(min(left[p] // n for p, n in take))
            for p, n in take:
                runs.append((int(lengths[p]), int(used[p]), int(used[p] + n * times), container, n))
                used[p] += n * times
                left[p] -= n * times
            container += times
            inside, shorter = [p for p in inside if left[p]], [p for p in shorter if left[p]]
    return runs, bound_of, container


def _last_fit(lengths: np.ndarray, live: list[int], hi: int, space: int) -> int:
    lo = 0
    while lo < hi:
        mid = (lo + hi) // 2
        if lengths[live[mid]] <= space:
            lo = mid + 1
        else:
            hi = mid
    return lo - 1


def pack_budgets(items: DataFrame, budgets: DataFrame, k: int = BUCKETS) -> DataFrame:
    """(budget_id, doc_id, piece_no, start_pos, n_tokens, bucket, container_id) for items (doc_id, n_tokens) and every row of budgets (budget_id, capacity), a fixed table.

    start_pos is the first token of the piece in its item; container_id counts
    from 1 in each budget; bucket is the upper length of the piece's bucket.
    """
    spark = items.sparkSession
    wanted = {r["budget_id"]: r["capacity"] for r in budgets.select("budget_id", "capacity").collect()}
    if not wanted:
        raise ValueError("no budgets")
    if min(wanted.values()) < 1:
        raise ValueError("capacity must be at least 1")
    size, capacity = F.coalesce("n_tokens", F.lit(0)), F.col("b.capacity")
    count = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity")) for b, c in sorted(wanted.items())])).alias("b")
    pieces = items.select("doc_id", size.alias("n_tokens"), each).select("doc_id", "n_tokens", "b", F.explode(F.sequence(F.lit(1), count)).alias("piece_no"))
    pieces = pieces.select("b.budget_id", "doc_id", "piece_no", ((F.col("piece_no") - 1) * capacity).cast("bigint").alias("start_pos"), F.least(capacity, F.col("n_tokens") - (F.col("piece_no") - 1) * capacity).cast("int").alias("len"))
    got = pieces.groupBy("budget_id", "len").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows a budget
    slices = max(SLICES, -(-max((r["n"] for r in got), default=0) // PER_SLICE))
    rows, containers = [], []
    for b, c in wanted.items():
        runs, bound_of, total = plan({r["len"]: r["n"] for r in got if r["budget_id"] == b and r["len"]}, c, k)
        by_len: dict[int, list] = {}
        for x, first, last, at, m in runs:
            by_len.setdefault(x, []).append((first, last, at, m))
        rows += [(b, x, bound_of[x], r) for x, r in by_len.items()]
        containers.append((b, max(1, total)))
    table = spark.createDataFrame(rows, "budget_id int, len int, bucket int, runs array<struct<a:bigint,b:bigint,c:bigint,m:bigint>>")
    none = F.create_map(*[F.lit(v) for kv in containers for v in kv])
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(slices)).cast("int"))
    filled = pieces.filter("len > 0")
    # per length at most as many rows as slices
    earlier = Window.partitionBy("budget_id", "len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.groupBy("budget_id", "len", "slice").agg(F.count("*").alias("n")).select("budget_id", "len", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("budget_id", "len", "slice").orderBy("doc_id", "piece_no")) - 1
    numbered = filled.withColumn("no", number).join(offsets, ["budget_id", "len", "slice"]).withColumn("no", F.col("no") + F.col("base"))
    # the plan is bounded by the capacities, whatever the number of items
    placed = numbered.join(F.broadcast(table), ["budget_id", "len"])
    run = F.element_at(F.filter("runs", lambda r: (r["a"] <= F.col("no")) & (F.col("no") < r["b"])), 1)
    placed = placed.withColumn("run", run)
    where = F.col("run.c") + F.floor((F.col("no") - F.col("run.a")) / F.col("run.m")) + 1
    out = placed.select("budget_id", "doc_id", "piece_no", "start_pos", F.col("len").alias("n_tokens"), "bucket", where.cast("bigint").alias("container_id"))
    riders = pieces.filter("len = 0").select("budget_id", "doc_id", "piece_no", "start_pos", F.col("len").alias("n_tokens"), F.lit(0).alias("bucket"), (F.pmod(F.xxhash64("doc_id"), none[F.col("budget_id")]) + 1).cast("bigint").alias("container_id"))
    return out.union(riders)


def pack(items: DataFrame, capacity: int, k: int = BUCKETS) -> DataFrame:
    """pack_budgets() for one capacity, without budget_id."""
    one = items.sparkSession.createDataFrame([(1, capacity)], "budget_id int, capacity int")
    return pack_budgets(items, one, k).drop("budget_id")


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, containers, tokens, fill): how full the containers are."""
    got = packed.groupBy("budget_id").agg(F.max("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return got.join(F.broadcast(budgets.select("budget_id", "capacity")), "budget_id").select("budget_id", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))

