"""Operators on small fixtures, with ties, nulls and empty frames."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import joins, judge, masks, metrics, monitoring, ranking, scorer, serving
from tessella.plans.ordinals import with_ordinal
from tessella.plans.spread import spread_join
from tessella.sources import readers

FACTS = "pred string, gold string, answer_type string, modality string, location string, q_lang string, content_type string, base_type string"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("yes", "Yes", "CLOSED", "CT", "a", "en", None, "vqa"), ("no", "yes", "closed", "CT", None, "en", None, "vqa"), ("left lung", "lung left", "OPEN", "MRI", "a", "en", "Organ", "vqa"),
        ("", "liver", "open", None, "b", "zh", "Organ", "kvqa"), (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, FACTS)


def test_metrics_add_up(facts):
    sub = metrics.subgroups(facts).collect()
    n = facts.count()
    for dim in metrics.DIMENSIONS:
        assert sum(r.n for r in sub if r.dim == dim) == n
    got = {r.key: r for r in metrics.exact_match(facts, F.upper(F.coalesce("answer_type", F.lit("")))).collect()}
    assert got["CLOSED"].n == 2 and got["CLOSED"].accuracy == 0.5 and got["OPEN"].correct == 0
    total = metrics.overall(facts).first()
    assert total.open_f1 == 0.5 and total.overall_score == pytest.approx(0.5 * total.closed_accuracy + 0.25)


def test_metrics_of_nothing(facts):
    none = facts.limit(0)
    assert metrics.overall(none).first().overall_score == 0.0
    assert metrics.subgroups(none).count() == 0
    assert metrics.recall(none).first().recall_yes == 0.0


def test_correlation_guards(spark):
    c = lambda rows: metrics.correlation(spark.createDataFrame(rows, "a double, b double"), F.col("a"), F.col("b")).first().r
    assert c([(1.0, 2.0), (1.0, 3.0)]) == 0.0 and c([]) == 0.0 and c([(1.0, 2.0)]) == 0.0
    assert c([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == 1.0


def test_margins(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", None)], "k string, margin double")
    got = {r.key: r for r in metrics.margin_stats(d, F.col("k")).collect()}
    assert got["a"].p90 == pytest.approx(7.9) and got["a"].median == 2.5 and got["b"].mean == 0.0


def test_top_values_ties(spark):
    d = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), ("", 0), (None, 5)], "v string, at int")
    assert [r.value for r in metrics.top_values(d, F.col("v"), "at", 2).collect()] == ["b", "a"]


def test_best_second(spark):
    d = spark.createDataFrame([(1, "x", 0.5, 0), (1, "y", 0.5, 1), (2, "z", 0.1, 0), (3, "w", None, 0)], "q int, l string, s double, p int")
    got = {r.q: r for r in ranking.best_second(d, ["q"], "l", "s", "p").collect()}
    assert got[1].best_label == "x" and got[1].margin == 0.0 and got[2].second_score == 0.1 and 3 not in got


def test_ordinals_and_chunks(spark):
    d = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1009)
    got = with_ordinal(d, "k").orderBy("k").collect()
    assert [r.ordinal for r in got] == list(range(1000))
    sizes = [r["count"] for r in ranking.chunks(d, "k", 7).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [143] * 6 + [142]
    assert ranking.representatives(d, "k").count() == 4
    assert with_ordinal(d.limit(0), "k").count() == 0


def test_run_batches(spark):
    rows = [(i, k, b) for i, (k, b) in enumerate([("O", 16)] * 5 + [("C", 0)] + [("O", 16), ("O", 48), ("O", 48)])]
    d = spark.createDataFrame(rows, "i int, k string, b int").withColumn("g", F.lit(1))
    got = ranking.run_batches(d, ["g"], ["i"], F.col("k") == "O", F.col("b"), 4).orderBy("i").collect()
    assert [(r.run_no, r.batch_in_run) for r in got] == [(1, 0)] * 4 + [(1, 1), (None, None), (2, 0), (3, 0), (3, 0)]


def test_sampling(spark):
    d = spark.range(100).select(F.col("id"), (F.col("id") % 10 == 0).alias("o"), (F.col("id") % 3).alias("s"))
    a = ranking.stratified_probe(d, ["s"], F.col("id"), 9, 1).collect()
    assert a == ranking.stratified_probe(d, ["s"], F.col("id"), 9, 1).collect() and sorted(r.s for r in a) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    b = ranking.balanced_sample(d, F.col("o"), F.col("id"), 30, 1).collect()
    assert len(b) == 30 and sum(r.o for r in b) == 10
    v = spark.createDataFrame([("Liver",), ("Heart",), ("Lung",), ("Kidney",)], "item string")
    k = spark.createDataFrame([(1, "Liver"), (2, None)], "k int, g string")
    n = ranking.seeded_negatives(k, "k", "g", v, 2, 7).collect()
    assert n == ranking.seeded_negatives(k, "k", "g", v, 2, 7).collect() and not any(r.k == 1 and r.item == "Liver" for r in n) and len(n) == 4
    assert ranking.weighted_lottery(d, "s", F.col("id"), 3).first().s > 0


def test_vocab_overlap_against_brute_force(spark):
    vocab = {"left lung": ["left", "lung"], "heart": ["heart"], "right lung": ["right", "lung"], "colon": ["colon"]}
    qs = {"q1": ["left", "lung", "left"], "q2": ["nothing"], "q3": ["heart", "lung"]}
    v = spark.createDataFrame(list(vocab.items()), "answer string, tokens array<string>")
    q = spark.createDataFrame(list(qs.items()), "k string, tokens array<string>")
    got = {(r.k, r["rank"]): (r.answer, r.overlap) for r in ranking.vocab_overlap(q, "k", "tokens", v, 3).collect()}
    for k, t in qs.items():
        want = sorted(((a, len(set(t) & set(w))) for a, w in vocab.items()), key=lambda x: (-x[1], x[0]))[:3]
        assert [got[k, i + 1] for i in range(3)] == want


def test_joins(spark):
    build = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    probe = spark.createDataFrame([(1, 10), (3, 30), (1, 11)], "k int, p int")
    assert sorted((r.p, r.v) for r in joins.probe_join(probe, build, "k", ["at"], ["v"]).collect()) == [(10, "b"), (11, "b")]
    fixed = joins.patch(build.select("k", "v"), spark.createDataFrame([(2, "z"), (1, None)], "k int, v string"), "k", ["v"])
    assert sorted(r.v for r in fixed.collect()) == ["a", "b", "z"]
    own = joins.owned_variants(spark.createDataFrame([(1, ["A", "a"])], "i int, b array<string>"), "i", "b", F.array("base", F.lower("base"))).collect()
    assert {(r.base, r.variant) for r in own} == {("A", "A"), ("A", "a")}


def test_spread_join_is_whole_for_hot_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    for few in (0, 10**6):
        got = spread_join(left, right, ["k"], "n", F.col("id"), ["m"], least=100, broadcast_rows=few)
        assert got.count() == 5000 and got.filter("m is null").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    r = nulls.groupBy("k").agg(F.count("*").alias("n"))
    assert spread_join(nulls, r, ["k"], "n", F.col("id"), ["n"], broadcast_rows=0).count() == 2


def test_masks(spark):
    px = [("i", y, x, 150) for y in range(2, 5) for x in range(2, 5)] + [("i", y, x, 30) for y in range(6, 8) for x in range(6, 9)] + [("i", 0, 0, 0)]
    d = spark.createDataFrame(px, "img string, y int, x int, class_id int")
    labels = spark.createDataFrame([(150, "Kidney Cancer"), (30, "Liver")], "class_id int, label string")
    assert masks.union_mask(d, ["img"]).count() == 15
    assert masks.disease_pixels(d, labels).count() == 9
    box = spark.createDataFrame([("i", y, x) for y in range(3, 7) for x in range(3, 7)], "img string, y int, x int")
    b = masks.bounding_boxes(box, ["img"], F.lit(10), F.lit(10)).first()
    assert (b.x1 - b.x0, b.y1 - b.y0) == (6, 6)
    rule = lambda *v: spark.range(1).select(masks.mask_rule(F.array(*[F.lit(x) for x in v])).alias("r")).first().r
    assert (rule(0), rule(0, 255), rule(0, 1), rule(0, 7)) == ("threshold", "threshold", "positive", "nonzero")
    other = d.select("img", "y", "x", F.lit(2).alias("v"))
    assert masks.pixel_difference(d.select("img", "y", "x", F.lit(0).alias("v")), other, ["img"]).first()["diff"] == 2.0


def test_judge(spark):
    d = spark.createDataFrame([("conv", "mri", "8 4\nx"), ("conv", None, "4 4"), ("det", "mri", "bad")], "kind string, domain string, review string")
    got = {r.grp: r for r in judge.summary(d, "kind", "domain", "review").collect()}
    assert got["overall"].n == 2 and got["overall"].relative == 75.0 and got["mri"].score1 == 8.0 and "det" not in got


def test_monitoring_and_serving(spark):
    e = spark.createDataFrame([("a", 0.0), ("b", 25.0), ("c", 500.0), ("d", -1.0), ("e", None)], "n string, value double")
    assert {r["bin"]: r.n for r in monitoring.histogram(e, "value", 0.0, 500.0, 20).collect()} == {0: 1, 1: 1, 2: 1, 21: 1}
    bad = spark.createDataFrame([("1.5",), ("NaN",), ("inf",), ("x",), (None,)], "v string")
    assert monitoring.clean_scalars(bad, "v").count() == 1
    beats = spark.sql("select * from values ('w', timestamp'2024-01-01 00:00:00', 1, 1), ('w', timestamp'2024-01-01 00:00:20', 2, 2), ('w', timestamp'2024-01-01 00:01:00', 3, 3) as t(w, ts, q, i)")
    assert serving.sessions(beats, "w", "ts", 30).count() == 2
    s = serving.latest_state(beats, "w", "ts", ["q"], "i").first()
    assert s.q == 3
    assert serving.alive(serving.latest_state(beats, "w", "ts", ["q"], "i"), F.lit("2024-01-01 00:01:31").cast("timestamp"), 30).count() == 0


def test_scorer(spark):
    r = spark.createDataFrame([(1, "left lung", ["lung", "heart"]), (2, "x", []), (3, None, None)], "qid bigint, prompt string, candidates array<string>")
    got = scorer.apply_scorer(r, scorer.overlap_score).orderBy("position").collect()
    assert [x.candidate for x in got] == ["lung", "heart"] and got[0].logprob_sum > got[1].logprob_sum


def test_sources(spark, tmp_path):
    root = tmp_path / "s"
    root.mkdir()
    (root / "train.json").write_text('[{"qid": 1, "question": "Q", "triple": ["a", "b", "c"], "q_lang": null}, {"qid": 2, "triple": [["x","y","z"]], "answer": null}]')
    df = readers.coerce(readers.read_split(spark, str(root), "train"))
    rows = {r.qid: r for r in df.collect()}
    assert rows[1].triple == [["a", "b", "c"]] and rows[1].q_lang == "en" and rows[2].answer == "" and rows[2].triple == [["x", "y", "z"]]
    with pytest.raises(ValueError):
        readers.read_split(spark, str(root), "dev")
    lines = spark.createDataFrame([("1: a:b", 0), ("x:y", 1), ("", 2), ("nocolon", 3), ("1:c", 4), ("7:", 5)], "value string, at int")
    assert {r.class_id: r.label for r in readers.parse_id_labels(lines).collect()} == {1: "c", 7: ""}
    readers.write_jsonl(df.select("qid", F.lit(None).cast("string").alias("n")), str(tmp_path / "j"))
    back = readers.read_jsonl(spark, str(tmp_path / "j"), "qid bigint, n string")
    assert back.count() == 2 and '"n":null' in spark.read.text(str(tmp_path / "j")).first().value
    readers.write_json_array(df.select("qid", "question"), str(tmp_path / "a"), "qid")
    assert spark.read.option("multiLine", True).json(str(tmp_path / "a")).count() == 2
    readers.write_csv(df.select("qid"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="is missing"):
        readers.strict(readers.read_split(spark, str(root), "train")).collect()
