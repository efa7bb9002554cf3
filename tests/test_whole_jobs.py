"""Queries over whole conversations and vocabularies, limits of the label mask, and numbering inside hot groups."""

import random

from tessella.plans import catalog
from tessella.plans.ordinals import with_number_in


def test_numbers_in_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), k % 700) for k in range(2000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g int, k int, i int")
    got = sorted((r.g, r.n, r.k, r.i) for r in with_number_in(df, "g", "k", "n", ["i"], slices=8).collect())
    want, last = [], {}
    for g, k, i in sorted((g, k, i) for i, (g, k) in enumerate(rows)):
        last[g] = last.get(g, 0) + 1
        want.append((g, last[g], k, i))
    assert got == sorted(want)
    assert with_number_in(df.limit(0), "g", "k", "n").count() == 0


def test_every_turn_of_an_image(spark, tmp_path):
    rows = [(k, 7, f"q{k}", f"a{k}") for k in range(1, 41)] + [(50, 8, "q", "a"), (51, 8, "", "a"), (52, 8, None, "a"), (53, 0, "q", "a")]
    spark.createDataFrame(rows, "rec_id bigint, img_id bigint, question string, answer string").write.parquet(str(tmp_path / "qa_record.parquet"))
    got = {(r.img_id, r.turn): r.prompt for r in catalog.QUERIES["conversation_turns"](spark, str(tmp_path)).collect()}
    assert got == {(7, k): f"[INST] q{k} [/INST] a{k} </s>" for k in range(1, 41)} | {(8, 1): "[INST] q [/INST] a </s>"}
    whole = {(r.img_id, r.part): r.prompt for r in catalog.QUERIES["conversation_prompts"](spark, str(tmp_path)).collect()}
    assert whole == {(7, 1): "".join(got[7, k] for k in range(1, 41)), (8, 1): got[8, 1]}


def test_label_mask_cuts_at_its_limits(spark):
    from pyspark.sql import functions as F

    from tessella.functions import arrays as A

    m = spark.createDataFrame([("q" * 600, "a" * 70), ("q", "a")], "q string, a string").select(A.label_mask(A.char_tokens(F.col("q")), A.char_tokens(F.col("a"))).alias("m")).select("m.*").collect()
    assert [(r.prompt_length, r.answer_length, r.prompt_truncated, r.answer_truncated) for r in m] == [(512, 64, True, True), (1, 1, False, False)]
    assert m[0].labels == [-100] * 512 + m[0].input_ids[512:]


def test_negatives_from_a_ring(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessella.operators import ranking

    keys = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("v"), (F.col("id") % 30).cast("string")).alias("gold"))
    vocab = spark.range(30).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("item"))
    got = sorted(map(tuple, ranking.seeded_negatives(keys, "key", "gold", vocab, 3, 7).collect()))
    assert len(got) == 1200 and all(v != f"v{k % 30}" for k, v, _ in got) and len({(k, v) for k, v, _ in got}) == 1200 and {r for _, _, r in got} == {1, 2, 3}
    few = ranking.seeded_negatives(keys, "key", "gold", vocab.limit(2), 3, 7)
    assert few.count() == 400 * 2 - keys.join(vocab.limit(2), F.col("gold") == F.col("item")).count()
    assert ranking.seeded_negatives(keys, "key", "gold", vocab.limit(0), 3, 7).count() == 0
    monkeypatch.setattr(ranking, "RING_ITEMS", 5)
    assert len({(r.key, r.item) for r in ranking.seeded_negatives(keys, "key", "gold", vocab, 3, 7).collect()}) == 1200


def test_candidates_beyond_the_twentieth_label(spark, tmp_path):
    rows = [(k, f"Name thing {k}.", f"label {k % 230}", "CLOSED", "train") for k in range(700)]
    spark.createDataFrame(rows, "rec_id bigint, question string, answer string, answer_type string, split string").write.parquet(str(tmp_path / "qa_record.parquet"))
    got = {(r.route, r.n_labels) for r in catalog.QUERIES["closed_candidates"](spark, str(tmp_path)).collect()}
    assert got == {("vocab", 200)}
