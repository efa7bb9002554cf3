"""Overlaps between splits: named pairs, and lists against all pairs."""

import random

from pyspark.sql import functions as F

from tessella.llm import split_overlap as S

SCHEMA = "rec_id bigint, img_id bigint, img_name string, question string, answer string, split string, q_lang string, source string"


def make(spark, rows):
    return spark.createDataFrame([(r, i, None, q, a, s, "en", "src") for r, i, q, a, s in rows], SCHEMA).withColumn("block", F.lit(1)).withColumn("tid", F.lit(2)).withColumn("train", F.lit(3))


ORGANS = ["left lung", "right lung", "heart", "liver", "spleen", "colon"]


def filler():
    return [(10_000 + k, 900 + k, f"Is the {ORGANS[k % 6]} visible in this scan?", "x", "train") for k in range(120)]


def test_named_pairs(spark):
    q = "Is the left lung visible in this scan?"
    rows = [
        (1, 1, q, "Yes", "train"), (2, 1, "  is the LEFT lung visible in this scan", "yes.", "test"), (3, 1, "Please tell me: is the left lnug visible in the scan? Thanks.", "YES", "validation"), (4, 1, "Is the right lung visible in this scan?", "Yes", "test"),
        (5, 1, q, "No", "test"), (6, 2, q, "Yes", "test"), (7, 1, q, "Yes", "train"), (8, 1, "Is point (3, 4) bright?", "Yes", "train"), (9, 1, "Is point (3, 5) bright?", "Yes", "test"), (10, 1, "(Is point (3, 4) bright?)", "Yes", "test"),
        (11, None, q, "Yes", "train"), (12, None, q, "Yes", "test"), (13, 1, None, "Yes", "test"), (14, 1, q, "Yes", None), (15, 3, "所示切片中脾脏呈什么颜色？", None, "train"), (16, 3, "请问，所示切片中脾脏呈哪种颜色呢", "", "test"),
    ]
    got = {(r.rec_id_a, r.rec_id_b) for r in S.found(make(spark, rows + filler())).collect()}
    assert got == {(1, 2), (1, 3), (2, 7), (3, 7), (8, 10), (15, 16)}
    rep = {r.split: (r.records, r.links) for r in S.report(make(spark, rows + filler())).collect()}
    assert rep == {"test": (3, 4), "validation": (1, 2)}


def test_lists_lose_no_pair(spark):
    rng = random.Random(2)
    words = ["alpha", "bravo", "carbon", "delta", "ember", "falcon", "garnet", "harbor"]
    rows = [(k, 1, " ".join(rng.sample(words, rng.randint(2, 5))), "x", rng.choice(["train", "test"])) for k in range(1, 150)]
    df = make(spark, rows)
    got = {(r.rec_id_a, r.rec_id_b) for r in S.found(df).collect()}
    from tessella.plans.cut import Scratch

    v = S.Vectors(*S._frequencies(S._texts(df, Scratch(spark, "t"))))
    want = set()
    for ra, _, qa, _, sa in rows:
        for rb, _, qb, _, sb in rows:
            if sa == "train" and sb == "test":
                if qa == qb or v.cosine(qa, qb) >= S.THRESHOLD:
                    want.add((min(ra, rb), max(ra, rb)))
    assert got == want and want


def test_rare_words_part_questions(spark):
    """Organs far under any share of the questions: never a pair with each other, still one with their own misspelling."""
    rare = ["esophagus", "pericardium", "pancreas", "thymus", "ileum", "ilium"]
    q = "Is there a lesion in the lung visible near the {}?"
    rows = [(k, 50 + k % 7, q.format(ORGANS[k % 6]), "Yes", "train") for k in range(3000, 4500)]
    rows += [(k, 1, q.format(o), "Yes", "train") for k, o in enumerate(rare, 1)] + [(100 + k, 1, q.format(o), "Yes", "test") for k, o in enumerate(rare, 1)]
    rows += [(201, 1, "Is there a lesion in the lung visible near the pericaridum?", "Yes", "test"), (202, 1, "is there a lesion in the lung seen near the esophaguss", "Yes", "test"), (203, 1, "Is there a lesion in the lung visible?", "Yes", "test")]
    for k in range(600, 620):  # the two short ones are known words, so none is a slip of the other
        rows += [(k, k, q.format(rare[4 + k % 2]), "Yes", "train")]
    got = {(r.rec_id_a, r.rec_id_b) for r in S.found(make(spark, rows)).collect() if r.rec_id_a < 50}
    assert got == {(k, 100 + k) for k in range(1, 7)} | {(2, 201), (1, 202)}


def test_slips_in_many_unlabelled_questions(spark):
    """A misspelling that unlabelled questions hold often, but in a small share, stays a slip."""
    q = "Is the {} visible in this scan?"
    rows = [(k, 1000 + k, q.format("spleeen" if k % 400 == 4 else ORGANS[k % 6]), "x", "train") for k in range(3000, 7000)]
    rows += [(1, 1, q.format("spleen"), "Yes", "train"), (2, 1, q.format("spleeen"), "Yes", "test"), (3, 1, q.format("liver"), "Yes", "test")]
    for label in ("en", None):
        df = make(spark, rows).withColumn("q_lang", F.when(F.col("rec_id") < 3000, F.lit(label)))
        assert {(r.rec_id_a, r.rec_id_b) for r in S.found(df).collect()} == {(1, 2)}


def test_slips_of_the_language_of_the_question(spark):
    """A slip as near to a word of another language is one of its own question's language."""
    en, fr = "What tissue lies at point ({}, 1) of slice 2?", "Quel tissu se trouve au point ({}, 1) de la coupe 2 ?"
    rows = [(k, 1000 + k, (en if k % 2 else fr).format(k), "x", "train") for k in range(3000, 4200)]
    rows += [(1, 1, en.format(7), "Yes", "train"), (2, 1, en.format(7).replace("tissue", "tisse"), "Yes", "test"), (3, 2, fr.format(7), "Oui", "train"), (4, 2, fr.format(7).replace("tissu", "tissuu"), "Oui", "test")]
    df = make(spark, rows).withColumn("q_lang", F.when(F.col("question").startswith("What"), "en").otherwise("fr"))
    assert {(r.rec_id_a, r.rec_id_b) for r in S.found(df).collect()} == {(1, 2), (3, 4)}


def test_members_hold_every_link(spark, monkeypatch):
    q = "Is the left lung visible in this scan?"
    rows = [(k, 1, q if k % 3 else q.upper() + " Thanks", "Yes", "train" if k % 4 else "test") for k in range(1, 200)]
    df = make(spark, rows + filler())
    pairs = [(r.rec_id_a, r.rec_id_b) for r in S.found(df).collect()]
    assert len(pairs) == sum(k % 4 > 0 for k in range(1, 200)) * sum(k % 4 == 0 for k in range(1, 200))
    got = {r.rec_id: (r.class_id, r.links) for r in S.members(df).collect()}
    assert {r: n for r, (_, n) in got.items()} == {r: sum(r in p for p in pairs) for r in got} and len(got) == 199
    assert {c for c, _ in got.values()} == {1, 3}
    monkeypatch.setattr("tessella.plans.spread._few", lambda *a: False)
    assert sorted((r.rec_id_a, r.rec_id_b) for r in S.found(df).collect()) == sorted(pairs)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.found(none).count() == 0 and S.report(none).count() == 0 and S.members(none).count() == 0
