"""Defects: one rule at a time, then all over a frame, on both ways of the statistics."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import broken_pairs as B
from tessella.llm import languages as L


@pytest.fixture(scope="module")
def machines():
    return L.fit(*L.with_common(["Where does the cyst appear in this image", "Welche Ebene ist auf dem Bild dargestellt", "Quel plan est représenté sur ce scan", "Qué plano aparece en esta imagen"] * 5, ["en", "de", "fr", "es"] * 5))


def test_empty():
    assert all(B.is_empty(x) for x in (None, "", " \n", "-", "...", "N/A", "null", "None", "_", "\xa0", "n.a."))
    assert not any(B.is_empty(x) for x in ("No", "0", "nothing abnormal", "无异常"))


def test_copy():
    copy = lambda q, a: B.is_copy(B._bare(q), B._bare(a), a)
    q = "Which one looks larger, the heart or the liver?"
    assert all(copy(q, a) for a in (q, q.upper(), "A: " + q, "> " + q, q + " " + q, "“" + q[:-1] + "”", q.replace(" ", "_"), "Which one loooks larger, the heart or the liver?", "Quick question - which one looks larger, heart or the liver? Please answer.", "Which one appears bigger, the heart or the liver?"))
    assert not any(copy(q, a) for a in ("The heart", "the liver", "Heart", "The heart looks larger than the liver in this slice because of its outline."))
    assert copy("图片里能看到胆囊吗？", "图片里能看到胆囊吗") and not copy("图片里能看到胆囊吗？", "能看到")


def test_refusal():
    yes = ["I'm sorry, but I can't give an opinion on this scan.", "As a language model, this request is outside what I may answer", "对不起，我不能解读医学影像", "Leider muss ich diese Anfrage ablehnen!", "Lo siento, pero debo rechazar esta petición.", "Pardon, je ne peux pas donner d'avis sur ce cliché."]
    yes += ["I'd rather not say.", "My guidelines do not allow a reply here", "It isn't my place to judge this picture", "That is something only a doctor should tell you.", "You would have to ask the reporting physician", "Let's talk about something else instead", "No comment from me on this one.", "恕我不作判断", "这种事情只有医生才能告诉您", "按照规定我不可以回复。", "这个问题请去问主治医师", "我们还是聊点别的吧"]
    yes += ["Das sollte Ihnen nur ein Arzt sagen.", "Meine Richtlinien lassen keine Antwort zu", "Dazu möchte ich mich nicht äußern.", "Reden wir lieber über etwas anderes", "Seul un médecin devrait vous le dire", "Mes consignes m'interdisent de répondre.", "Je préfère ne rien dire à ce sujet", "Parlons d'autre chose", "Eso solo debería decírselo un médico.", "Mis normas no me dejan responder", "Prefiero no decir nada sobre esto", "Hablemos de otra cosa", "No puedo opinar sobre esta imagen."]
    no = ["The image shows only a small lesion.", "Nur ein kleiner Schatten.", "Seul le foie est visible.", "Solo un quiste.", "只有肝脏。", "No, the rectum cannot be seen at this level.", "The contour cannot be followed below the second level.", "Non, on ne voit pas la rate.", "否，看不到。"]
    assert all(map(B.is_refusal, yes)) and not any(map(B.is_refusal, no))


def test_cut():
    assert all(map(B.is_cut, ["It moves slow rh…", "It keeps ret-", "The area is drained,", "an edge (mostly along", "It looks enlarged with a"]))
    assert not any(map(B.is_cut, ["It looks enlarged.", "Left", "weil beide Seiten betroffen sind", "26.4 mm", "the parts next to it", "T2"]))


def test_keys_agree(spark):
    texts = ["  The 12.5 mm\tLesion. ", "«Sí»", "", "a-b", "第3层。", "X-Ray"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.answer_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == {t: B.python_key(t) for t in texts}


@pytest.mark.parametrize("few", [10**6, 0])
def test_frames(spark, machines, few):
    full = ["It filters waste products out of the blood slowly", "Rest and cooling are often enough for this patient"]
    rows = [(k, "What does the left lung do for the body?", full[k % 2], "OPEN", "en") for k in range(200)]
    rows += [(1000, "What does it do for the body?", "It filters waste products out of", "OPEN", "en"), (1001, "What does it do for the body?", "Rest and cooling are often eno", "OPEN", "en"), (1002, "What does it do for the body?", None, "OPEN", "en")]
    rows += [(1003, None, "fine", None, None), (1004, None, None, None, None), (1005, "Where does the cyst appear in this image?", "左上区", "OPEN", "en"), (1006, "图片里能看到胆囊吗？", "MRI", "OPEN", "zh")]
    df = spark.createDataFrame(rows, "rec_id bigint, question string, answer string, answer_type string, q_lang string").withColumn("cut", F.lit(1)).withColumn("key", F.lit(2)).withColumn("usual", F.lit(3))
    got = {r.rec_id: r.defect for r in B.all_defects(df, machines, first_only=True, broadcast_rows=few).collect()}
    assert got == {1000: "truncated", 1001: "truncated", 1002: "empty", 1004: "empty", 1005: "other_language"}
    assert B.all_defects(df.limit(0), machines, broadcast_rows=few).count() == 0


def test_both_ways_agree_on_the_whole_table(spark, machines):
    df = spark.read.parquet("/root/testdata/sf0.01/qa_record.parquet")
    got = [sorted(map(tuple, B.all_defects(df, machines, broadcast_rows=few).collect())) for few in (10**6, 0)]
    assert got[0] == got[1] and len(got[0]) > 300


def test_long_texts_are_quick(machines):
    check = B.Checker(L.Classifier(machines))
    q = "Where does the cyst appear in this image? " * 5000
    slips = "".join(c for i, c in enumerate(q) if i % 97)
    other = " ".join(f"Slice {k} shows part {k * 7} of the organ." for k in range(4000))
    assert check.defects(q, slips) == ["copy"] and "copy" not in check.defects(q, other)
    assert check.defects(q, q) == ["copy"] and "copy" not in check.defects(q, "It appears in the upper left zone of it. " * 5000)
