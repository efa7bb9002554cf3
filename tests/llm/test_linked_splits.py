"""Groups, forest and splits against a union-find."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import linked_splits as L
from tessella.plans.cut import Scratch

SCHEMA = "rec_id bigint, img_id bigint, img_name string"


def brute(rows):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    def name(x):
        if x is None:
            return None
        x = x.lower().replace("%2f", "/").replace("\\", "/").strip()
        return None if x in L.PLACEHOLDERS else "/".join([p.strip() for p in x.split("/") if p.strip() not in ("", ".")][-2:])

    for r, i, n in rows:
        for k in ([("i", i)] if i is not None and i > 0 else []) + ([("n", name(n))] if name(n) else []):
            up[find(k)] = find(("r", r))
    groups = {}
    for r, i, n in rows:
        groups.setdefault(find(("r", r)), []).append((r, i, n))
    of = {r: min(x[0] for x in g) for g in groups.values() for r, _, _ in g}
    found = {r: of[r] for g in groups.values() if len({(i, n) for _, i, n in g}) > 1 for r, _, _ in g}
    return of, found


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("group_id", F.lit(1)).withColumn("root", F.lit(2))


def test_names(spark):
    same = ["rad1/view.png", " RAD1/VIEW.PNG ", "img\\rad1\\view.png", "./img/rad1/view.png", "/data/img/rad1//view.png", "rad1%2Fview.png", "　rad1/view.png"]
    got = spark.createDataFrame([(x,) for x in same], "n string").select(L.usable_name(F.col("n")).alias("k")).distinct().collect()
    assert [r.k for r in got] == ["rad1/view.png"]
    none = spark.createDataFrame([(x,) for x in (None, "", "  ", "N/A", "none", "-")], "n string").select(L.usable_name(F.col("n")).alias("k")).distinct().collect()
    assert [r.k for r in none] == [None]


def test_chains_cycles_and_lone_records(spark):
    rows = [(1, 5, "a/x"), (2, 5, "b/x"), (3, 6, "b/x"), (4, 6, "c/x"), (5, None, "C\\X"), (6, 7, None), (7, 7, ""), (8, 0, None), (9, -1, "none"), (10, 5, "c/x"), (11, 9, "z/z"), (12, 9, "z/z")]
    of, found = brute(rows)
    df = make(spark, rows)
    assert {r.rec_id: r.group_id for r in L.linked_groups(df).collect()} == of
    assert {r.rec_id: r.group_id for r in L.found(df).collect()} == found
    _, forest = L.image_groups(df, Scratch(spark, "t"))
    links = forest.filter("child <> parent").select("id_key", "name_key").collect()
    assert len(links) == len({x for f in links for x in f}) - len({of[r] for r, i, n in rows if of[r] in (1, 11)})


def test_random_graphs(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 0, *range(1, 60)]), rng.choice([None, "", *[f"d/f{j}" for j in range(60)]])) for k in range(1, 120)]
    of, found = brute(rows)
    df = make(spark, rows)
    assert {r.rec_id: r.group_id for r in L.linked_groups(df).collect()} == of
    assert {r.rec_id: r.group_id for r in L.found(df).collect()} == found


def test_splits_keep_groups_and_shares(spark):
    rows = [(k, 1 if k % 10 == 0 else 2 + k % 700, None) for k in range(1, 4000)]
    got = L.splits(make(spark, rows))
    assert got.count() == len(rows) and got.groupBy("group_id").agg(F.count_distinct("split").alias("c")).filter("c > 1").count() == 0
    share = {r.split: r["count"] / len(rows) for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_small_tables_are_dealt_evenly(spark, sf):
    got = {r.split: r["count"] for r in L.splits(spark.read.parquet(f"/root/testdata/sf{sf}/qa_record.parquet")).groupBy("split").count().collect()}
    n = sum(got.values())
    most = 0.01 if sf == "0.01" else 0.02
    assert abs(got["train"] / n - 0.8) < most and abs(got["validation"] / n - 0.1) < most and abs(got["test"] / n - 0.1) < most


def test_forest_stays_and_gives_the_roots(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, *range(1, 90)]), rng.choice([None, *[f"d/f{j}" for j in range(90)]])) for k in range(1, 150)]
    of, _ = brute(rows)
    path = f"file://{tmp_path}/forest"
    links = L.spanning_forest(make(spark, rows), path).collect()
    kept = spark.read.parquet(path).filter("child <> parent").select("id_key", "name_key").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, links))
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in links:
        assert find(a) != find(b)  # no cycle
        up[find(a)] = find(b)
    key = lambda i, n: find(f"i{i}") if i else find(f"n{n}") if n else None
    roots = {}
    for r, i, n in rows:
        if key(i, n):
            roots.setdefault(key(i, n), set()).add(of[r])
    assert all(len(g) == 1 for g in roots.values()) and len(roots) == len({g for s in roots.values() for g in s})


def test_no_side_broadcast(spark, monkeypatch):
    """The salted way of every join gives the same groups."""
    monkeypatch.setattr("tessella.plans.spread._few", lambda *a: False)
    data = [(k, 1 if k % 3 else 2 + k % 40, f"d/f{k % 50}" if k % 7 else None) for k in range(1, 300)]
    of, found = brute(data)
    assert {r.rec_id: r.group_id for r in L.linked_groups(make(spark, data)).collect()} == of
    assert {r.rec_id: r.group_id for r in L.found(make(spark, data)).collect()} == found


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.found(none).count() == 0 and L.splits(none).count() == 0 and L.spanning_forest(none).count() == 0
