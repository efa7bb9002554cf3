"""Languages: labels, held-out accuracy, segments."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import languages as L


@pytest.fixture(scope="module")
def fitted():
    rows = pq.read_table("/root/testdata/sf0.01/qa_record.parquet", columns=["question", "answer", "q_lang"]).to_pylist()
    random.Random(1).shuffle(rows)
    clean = [(r["question"], lang) for r in rows if (lang := L.label_code(r["q_lang"])) in ("en", "de", "fr", "es") and L._WORD.search(r["question"] or "") and not L._HAN.search(r["question"]) and not any(x in r["question"][:-1] for x in "?./|\n-")]
    half = len(clean) // 2
    m = L.fit(*L.with_common([q for q, _ in clean[:half]], [lang for _, lang in clean[:half]]))
    return m, clean[half:]


def test_labels(spark):
    want = {"EN": "en", " en ": "en", "en-US": "en", "English": "en", "zh_Hans": "zh", "ZH-CN": "zh", "German": "de", "deu": "de", "fr-CA": "fr", "spa": "es", "ja": "ja", "?": None, "n/a": None, "und": None, "": None, None: None}
    assert {k: L.label_code(k) for k in want} == want
    rows = spark.createDataFrame([(k,) for k in want], "k string").select("k", L.label_column(F.col("k")).alias("c")).collect()
    assert {r.k: r.c for r in rows} == want


def test_held_out_accuracy(fitted):
    m, rest = fitted
    c = L.Classifier(m)
    got = [(c.latin(L._WORD.findall(q.lower()))[0], lang) for q, lang in rest]
    # about 3 % of the labels themselves are wrong
    assert sum(a == b for a, b in got) / len(got) > 0.93


SEGMENTS = {
    "Is the left lung visible in this scan?": ["en"],
    "Is the left kidney (左肾) visible? Merci.": ["en"],
    "图片里能看到胆囊（gallbladder）吗？": ["zh"],
    "Quick question - is a stone present in the right eye?": ["en"],
    "Doctor, Quick question - Is a stone present in the right eye?": ["en"],
    "Is \nthe \nleft \nlung \nvisible \nin \nthis \nscan?": ["en"],
    "Voit-on la rate sur ce scan ? Der Patient lag auf der linken Seite. Nous voulons seulement ce qui est visible ici.": ["fr", "de", "fr"],
    "这幅扫描图中能看到甲状腺吗？ / Ist die Schilddrüse in dieser Aufnahme zu erkennen?": ["zh", "de"],
    "Mire primero el borde inferior.\nHow is a stone usually treated?": ["es", "en"],
    "Please keep the answer short. ¿Hay un quiste que afecte el colon?": ["en", "es"],
    "左肺はこの画像で見えますか？": ["ja"], "Виден ли на этом снимке желчный пузырь?": ["ru"], "क्या इस चित्र में यकृत दिखाई देता है?": ["hi"], "เห็นตับในภาพนี้หรือไม่": ["th"], "이 영상에서 간이 보입니까?": ["ko"], "هل يظهر الكبد في هذه الصورة؟": ["ar"], "Φαίνεται το ήπαρ σε αυτή την εικόνα;": ["el"],
    "Ձախ թոքը երևո՞ւմ է այս պատկերում": ["und"], "Wstrząsający przejrzyściejszy źdźbło chrząszcz": ["und"], "この画像で肝臓が見えますか？ Is the left lung visible in this scan?": ["ja", "en"], "Où est le foie ? Где находится печень на этом снимке?": ["fr", "ru"],
    "12, 34?": [],
    "": [],
}


@pytest.mark.parametrize("text", SEGMENTS)
def test_segments(fitted, text):
    got = L.Classifier(fitted[0]).segments(text)
    assert [s[0] for s in got] == SEGMENTS[text]
    assert all(0 < s[1] <= 1 and 0 <= s[2] < s[3] <= len(text) for s in got)


def test_frames(spark, fitted):
    rows = [(1, "Is the left lung visible here?", "de"), (2, "Is the left lung visible here?", "en-GB"), (3, None, None), (4, "图片里能看到胆囊吗？", None), (5, "Voit-on la rate sur ce scan ? Der Patient lag auf der linken Seite.", "fr")]
    df = spark.createDataFrame(rows, "rec_id bigint, question string, q_lang string").withColumn("lang", F.lit("x")).withColumn("seg_no", F.lit(9))
    assert sorted(map(tuple, L.found(df, fitted[0]).collect())) == [(1, 1, "en"), (4, 1, "zh"), (5, 1, "fr"), (5, 2, "de")]
    assert L.segments(df, fitted[0]).count() == 5
    assert L.found(df.limit(0), fitted[0]).count() == 0


def test_fit_is_the_same_however_rows_lie(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/qa_record.parquet")
    a, b = (L.train(x, ["question", "answer"], "q_lang", 3000) for x in (df.coalesce(1), df.repartition(7)))
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all()


def test_no_text_with_letters_is_silent(fitted):
    c = L.Classifier(fitted[0])
    for t in ("肝", "пе", "a", "ก", "ሀ", "é", "x 1", "(Б)"):
        assert c.segments(t), t


def test_training_on_little(spark):
    few = spark.createDataFrame([(1, "hello there my friend", "x", "en"), (2, None, None, None)], "rec_id bigint, question string, answer string, q_lang string")
    m = L.train(few, ["question", "answer"], "q_lang")
    assert L.Classifier(m).segments("Der Patient lag auf der linken Seite")[0][0] == "de"
    assert L.found(few.limit(0)).count() == 0
