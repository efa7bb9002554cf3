"""Free-typed values: the metric, the tree against brute force, and named cases on both ways."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import canonical_values as V

REF = [
    (1, "Left Kidney", ["左肾"]), (2, "Right Kidney", ["右肾"]), (3, "Heart", ["Cardiac Muscle", "心脏"]), (4, "Computed Tomography", ["CT", "CAT scan"]), (5, "Digestive System", []), (6, "Motor System", None),
    (7, "Tumor", ["Neoplasm"]), (8, "Cyst", []), (9, "Left Ventricle", []), (10, "Small Intestine", ["Small Bowel"]), (11, "Cirrhosis", []), (12, "Fibrosis", []), (13, "Enlarged Heart", []),
]
WANT = {
    "Left kidney": 1, "left  kidney.": 1, "kidney, left": 1, "kidney (right": 2, "L. Kidney": 1, "rt kidney": 2, "leftkidney": 1, "probably left kidney": 1, "the left kdiney region (see arrow": 1, "左肾（可能）": 1, "hart": 3, "cardiac muscle": 3,
    "cat scan": 4, "CT": 4, "mostlikelythetumor": 7, "tmor": 7, "tumors": 7, "left ventr.": 9, "Leftventr.": 9, "small bowel area": 10, "cirosis": 11, "enlarged heart": 13, "rtkidney": 2, "l ventricle（可能）": 9, "smallintest": 10, "computedtomogr": 4,
    "kidney": -1, "system": -1, "tumor plus cyst": -1, "left or right kidney": -1, "42": -1, "right side": -1, "hip screw": -1, "see report": -1, "左": -1, "yes": -1, "心脏左肾": -1,
}


def ref(spark):
    return spark.createDataFrame(REF, "canon_id bigint, label string, aliases array<string>").withColumn("value", F.lit("clash"))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance_is_a_metric(a, b, c):
    d = V.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_distance_cases():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        d = V.distance(a, b)
        assert all(V.distance(a, b, k) == d if d <= k else V.distance(a, b, k) > k for k in range(8))
    assert V.distance("ca", "abc") == 2 and V.distance("kdiney", "kidney") == 1 and V.distance("", "ab") == 2


def test_tree_returns_everything_within():
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    tree = V.BkTree(keys)
    for q in keys[:20] + ["zzz", ""]:
        for k in (0, 1, 2, 3):
            assert sorted(tree.within(q, k)) == sorted((x, d) for x in keys if (d := V.distance(q, x)) <= k)


@pytest.mark.parametrize("entries", [10**6, 0])
def test_cases(spark, entries):
    values = spark.createDataFrame([(k,) for k in WANT], "value string")
    got = {r.value: r.canon_id for r in V.match_values(values, ref(spark), broadcast_entries=entries, shards=3).collect()}
    wrong = {k: (got.get(k), w) for k, w in WANT.items() if got.get(k) != w}
    assert not wrong


BOTH = {
    **WANT, "tumor or xyz": -1, "left kidney upper": -1, "tumor or neoplasm": 7, "cyst vs tumor": -1, "tumor": 7, "cysts": 8, "left atrium or left kidney": -1, "uterus": 14, "uterine": -1, "plus": 15, "plus plus": 15,
    "左肾上腺": 16, "左肾上腺皮质": 16, "左肾上腺和心脏": -1, "左肾tumor": 1, "heartattack": 17, "hartattack": 17, "heartbeat": -1, "hertbaet": 19, "word " * 1200 + "left kidney": 1,
}
MORE = [(14, "Uterus", []), (15, "Plus", []), (16, "左肾上腺", []), (17, "Heart Attack", []), (18, "Heart Beat", []), (19, "Heartbeat", []), (20, "Ureters", [])]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_give_what_the_whole_list_gives(spark, shards):
    more = spark.createDataFrame(MORE, "canon_id bigint, label string, aliases array<string>")
    every = ref(spark).drop("value").unionByName(more)
    values = spark.createDataFrame([(k,) for k in BOTH], "value string")
    whole = {r.value: r.canon_id for r in V.match_values(values, every).collect()}
    got = {r.value: r.canon_id for r in V.match_values(values, every, broadcast_entries=0, shards=shards).collect()}
    assert got == whole
    assert {k[-40:]: (got[k], w) for k, w in BOTH.items() if got[k] != w} == {}


def test_shards_agree_on_the_whole_table(spark):
    results, reference = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("generation_result", "canonical_answer"))
    values = results.select(F.explode(F.array("answer", "normalized_generation")).alias("value")).filter("value is not null").distinct()
    whole = {r.value: r.canon_id for r in V.match_values(values, reference).collect()}
    for shards in (3, 16):
        assert {r.value: r.canon_id for r in V.match_values(values, reference, broadcast_entries=0, shards=shards).collect()} == whole


def test_misspelled_han_spellings():
    one = V._Decider(V.Matcher([(1, "左肾上腺皮质瘤"), (2, "右肾上腺皮质瘤"), (3, "心脏增大")]))
    assert one("左肾上腺皮质") == 1 and one("心脏曾大") == 3 and one("心脏") == -1 and one("肾上腺皮质瘤") == -1


def test_found(spark):
    rows = [(1, "Heart", "hart"), (2, None, " - "), (3, "heart", "Heart"), (4, "??", "zzz"), (5, "", None)]
    df = spark.createDataFrame(rows, "gen_id bigint, answer string, normalized_generation string").withColumn("field_name", F.lit("x")).withColumn("canon_id", F.lit(0))
    got = sorted((r.gen_id, r.field_name, r.canon_id) for r in V.found(df, ref(spark)).collect())
    assert got == [(1, "normalized_generation", 3), (3, "answer", 3), (4, "normalized_generation", -1)]
    assert V.found(df.limit(0), ref(spark)).count() == 0
    assert {r.canon_id for r in V.found(df, ref(spark).limit(0)).collect()} == {-1}


def test_long_values_are_quick():
    one = V._Decider(V.Matcher([(c, x) for c, label, al in REF for x in [label, *(al or [])]]))
    assert one("word " * 20000 + "left kidney") == 1 and one("x" * 200_000) == -1 and one("心" * 100_000) == -1
