"""Sentence units: named cases per language, and that only white space lies outside them."""

import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import sentences as S

CASES = [
    ["Dr. Holvane saw Fig. 3.", "It grew by 1.5 cm, e.g. at the rim.", "No."],
    ["Slices 3.1 to 4.1 were lost, cf. Fig. 2.", "J. R. Korvaine et al. report 3.5% of cases.", "He came at 9 a.m. on Monday.", "The U.S. protocol differs."],
    ['"Hold your breath!" was heard.', 'The note says: "No change."', "(It was not scanned.)", "Who marked it?!", "Wait... the left one is fine."],
    ["The margin is sharp.", "mAs values were not stored."],
    ["Dr. Yelstone sah am 24. Tag keine Änderung.", "Das betrifft u. a. den Rand, z. B. links.", "„Tut das weh?“, fragte die Ärztin.", "Siehe Abb. 4 bzw. Tab. 73.", "Prof. Drissol schrieb: „Kein Befund.“", "Vorsicht!"],
    ["Voir p. ex. la coupe no 2.", "« Avez-vous mal ? » demanda le médecin.", "Le Dr Yelstone note : « Rien. »", "Attention !"],
    ["—¿Le duele? —preguntó la doctora.", "El Sr. Holvane dijo: «No me duele».", "La Dra. Mabbary revisó la fig. 4.", "¿Hay un quiste?"],
    ["साथ ही, डॉ. Ostrevel ने चित्र 2 देखा।", 'रोगी ने कहा, "रात में दर्द होता है।"', '"क्या दर्द है?" डॉक्टर ने पूछा।', "कोई बदलाव नहीं।"],
]
TIGHT = [
    ["患者说：“晚上比较疼。”", "“这里疼吗？”医生问道。", "据Dr. Drissol记录，密度从18.7降至5.6。", "信号减低……需要复查。", "请注意！", "报告中写道：「正常。」"],
    ["「痛みはありません。」と患者は話した。", "医師は「もう一度」と言った。", "経過観察とする（次回は8日後）。", "「大丈夫ですか？いつ始まりましたか？」と聞かれた。", "胃に異常なし……要再検。"],
]


def texts(t):
    return [t[a:b] for a, b in S.boundaries(t)]


@pytest.mark.parametrize("want", CASES)
def test_spaced(want):
    assert texts(" ".join(want)) == want
    assert texts("  " + "\n".join(want) + "\n") == want


@pytest.mark.parametrize("want", TIGHT)
def test_without_spaces(want):
    assert texts("".join(want)) == want


def test_thai_and_layout():
    assert texts("ขอบเขตชัดเจนดี ถ่ายภาพทั้งหมด75ภาพ\nพบก้อนในตับ") == ["ขอบเขตชัดเจนดี", "ถ่ายภาพทั้งหมด75ภาพ", "พบก้อนในตับ"]
    assert texts("FINDINGS\r\n\r\n2. The liver is\nlarge\n\n- Fine.\n\nQ: Is it?\n \nA: Yes") == ["FINDINGS", "2. The liver is\nlarge", "- Fine.", "Q: Is it?", "A: Yes"]
    assert texts("of the spleen.The trachea is fine. See reports@a.example now.") == ["of the spleen.", "The trachea is fine.", "See reports@a.example now."]
    assert texts('He said "unclosed. Then more.') == ['He said "unclosed.', "Then more."]
    assert texts("(7) It ends ) here. [x") == ["(7) It ends ) here.", "[x"]
    for t in (None, "", " \n\t　", "..."):
        assert texts(t or "") == ([] if not (t or "").strip() else [t])
    assert S.boundaries(None) == []


def test_list_levels():
    assert texts("Plan:\n1. Rest\n2. Cooling. No weight\n  a) left\n  b) right\n3. Return") == ["Plan:", "1. Rest", "2. Cooling.", "No weight", "a) left", "b) right", "3. Return"]
    assert texts("The sizes were\n12. They grew") == ["The sizes were\n12.", "They grew"]  # no list: no level to continue
    assert texts("- one\n- two\nstill two\n\n- three") == ["- one", "- two\nstill two", "- three"]
    assert texts("一、肝脏\n二、脾脏") == ["一、肝脏", "二、脾脏"]
    assert texts("(He listed:\n1. a\n2. b) and left") == ["(He listed:\n1. a\n2. b) and left"]  # brackets hold their lists


def test_unmatched_marks_take_linear_time():
    began = time.time()
    for t in ("(" * 20_000 + "] " * 20_000, '"(' * 20_000, "[" * 20_000 + "”" * 20_000, '( "' * 20_000):
        S.boundaries(t)
    assert time.time() - began < 4


@settings(max_examples=300, deadline=None)
@given(st.text("ab1 A.)-!?\n\"“”«»()（）。「」 1…-é中ก\r", max_size=60))
def test_only_space_outside(t):
    at = 0
    for a, b in S.boundaries(t):
        assert at <= a < b <= len(t) and not t[at:a].strip() and t[a:b] == t[a:b].strip()
        at = b
    assert not t[at:].strip()


def test_long_text_is_quick():
    assert len(S.boundaries("A sentence (with 3.5 cm) here. " * 20000)) == 20000


def test_frames(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted((r["doc_id"], a, b) for r in pq.read_table(f"{data}/documents.parquet").to_pylist() for a, b in S.boundaries(r["text"]))
    assert sorted(map(tuple, S.sentences(docs).collect())) == want
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "One. Two.", 3)], "doc_id bigint, text string, start_pos int")
    assert sorted(map(tuple, S.sentences(odd).collect())) == [(3, 0, 4), (3, 5, 9)]
    assert [r.sentence for r in S.sentence_texts(odd).orderBy("sent_no").collect()] == ["One.", "Two."]
    assert S.sentences(odd.limit(0)).count() == 0
