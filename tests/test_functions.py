"""Functions against literal expectations, one row each."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import arrays as A
from tessella.functions import options as O
from tessella.functions import prompts as P
from tessella.functions import text as X


def one(spark, column, **values):
    """Value of a Column over one row of text values."""
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def col(c="t"):
    return F.col(c)


def test_normalize_answer(spark):
    cases = {"YES": "yes", "no": "no", "True": "yes", " Yes ": "yes", "N.": "no", "Left   Lung.": "left lung", "yes .": "yes ", "\xa0\t": "", None: "", "": "", "(a)": "a"}
    for t, want in cases.items():
        assert one(spark, X.normalize_answer(col()), t=t) == want, t


def test_lines_and_prefixes(spark):
    assert one(spark, X.short_answer(col()), t="Answer: lung") == "lung"
    assert one(spark, X.short_answer(col()), t="liver\nBecause it is visible.") == "liver"
    assert one(spark, X.first_non_empty_line(col()), t="\nAnswer: yes") == "yes"
    assert one(spark, X.first_non_empty_line(col()), t="\r\n   a\r\nb") == "a"
    assert one(spark, X.first_non_empty_line(col()), t=None) == ""
    assert one(spark, X.first_line(col()), t=" one \r\ntwo") == "one "


def test_yes_no_and_index(spark):
    assert one(spark, X.yes_no(col()), t="TRUE") == "yes"
    assert one(spark, X.yes_no(col()), t="maybe") is None
    assert one(spark, X.title_yes_no(col()), t=" y ") == "Yes"
    assert one(spark, X.is_image_index(col()), t=" Image 12 ") is True
    assert one(spark, X.is_image_index(col()), t="image one") is False


def test_token_f1(spark):
    f1 = lambda a, b: one(spark, X.token_f1(col("a"), col("b")), a=a, b=b)
    assert f1("left lung", "lung left") == 1.0
    assert f1("left lung apex", "left lung") == pytest.approx(0.8)
    assert f1("a a b", "a b b") == pytest.approx(2 / 3)
    assert f1("", "x") == 0.0 and f1(None, None) == 0.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=8), st.text("ab c", max_size=8)), min_size=1, max_size=8))
def test_token_f1_is_symmetric_and_bounded(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select(X.token_f1(col("a"), col("b")).alias("x"), X.token_f1(col("b"), col("a")).alias("y")).collect()
    assert all(r.x == pytest.approx(r.y) and 0 <= r.x <= 1 for r in rows)


def test_small_text_functions(spark):
    assert one(spark, X.truncate(col(), 10), t="abcdefghijk") == "abcdefg..."
    assert one(spark, X.csv_list(col()), t=" a, ,b,") == ["a", "b"]
    assert one(spark, X.judge_scores(col()), t="8 7.5\nwhy") == [8.0, 7.5]
    assert one(spark, X.judge_scores(col()), t="8\nwhy") is None
    assert one(spark, X.model_name(col()), t="/m/base/checkpoint-7/") == "base_checkpoint-7"
    assert one(spark, X.name_matches(col(), "q_proj,k_proj"), t="layer.q_proj") is True
    assert one(spark, X.name_matches(col(), "re:^vis"), t="layer.q_proj") is False
    assert one(spark, X.name_matches(col(), 'list:q_proj|k_proj'), t="q_proj") is False
    assert one(spark, X.name_matches(col(), "q_proj|k_proj"), t="k_proj") is True


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Which is correct? A. Liver B. Heart C. Lung", ["liver", "heart", "lung"]),
        ("Is it left kidney or right kidney?", ["left kidney", "right kidney"]),
        ("Is the modality CT or MRI?", ["ct", "mri"]),
        ("Plane: axial/coronal/sagittal?", ["axial", "coronal", "sagittal"]),
        ("Is it hyperdense vs hypodense?", ["hyperdense", "hypodense"]),
        ("Which is correct, benign, malignant, or normal?", ["benign", "malignant", "normal"]),
        ("Is there pleural effusion?", []),
        ("", []),
        (None, []),
    ],
)
def test_parse_options(spark, question, want):
    assert one(spark, O.parse_options(col()), t=question) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [("Which is bigger, lung,liver or heart?", ["lung", "liver", "heart"]), ("Choose A/B/C for the best option.", ["A", "B", "C"]), ("What does the image show?", []), ("Is the organ red?", [])],
)
def test_question_options(spark, question, want):
    assert one(spark, O.question_options(col()), t=question) == want


def test_routes_and_candidates(spark):
    route = lambda q, a: one(spark, O.closed_route(col("q"), col("a")), q=q, a=a)
    assert route("Is there pleural effusion?", "") == "yesno"
    assert route("Does the patient have fracture?", "x") == "yesno"
    assert route("Plane: axial/coronal/sagittal?", "axial") == "options"
    assert route("Name the organ.", "liver") == "vocab"
    c = one(spark, O.closed_candidates(col("q"), col("a"), F.array(F.lit("Liver"))), q="Name the organ.", a="liver")
    assert c["route"] == "vocab" and c["labels"] == ["Liver"]
    off = one(spark, O.closed_candidates(col("q"), col("a"), F.array(F.lit("Liver")), fallback=False), q="Name the organ.", a="liver")
    assert off["labels"] == []
    v = one(spark, O.candidate_variants(col()), t="yes")
    assert {"yes", "Yes", " yes", "Yes."} <= set(v) and len(v) == 16
    assert one(spark, O.option_target(F.array(F.lit("Left kidney"), F.lit("Right kidney"), F.lit("Liver")), col()), t="Right kidney") == 1
    assert one(spark, O.option_target(F.array(F.lit("x")), col()), t="y") == -1
    assert one(spark, O.length_normalized(F.lit(-1.5), F.lit(2))) > one(spark, O.length_normalized(F.lit(-1.0), F.lit(1)))


def triples(*t):
    return F.array(*[F.array(*[F.lit(x) for x in y]) for y in t])


def test_triples(spark):
    assert "respiratory system" in one(spark, P.format_triples(triples(["vhead", "belong to", "respiratory system"])))
    assert one(spark, P.format_triples(triples(["vhead", "_", "_"], ["vhead", "belong to", "digestive system"]))) == "(belong to, digestive system)"
    assert one(spark, P.format_triples(F.lit(None).cast("array<array<string>>"))) == ""
    assert one(spark, P.format_triples(P.wrap_flat(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))) == "(a, b, c)"
    assert one(spark, P.append_context(F.lit("Q?"), triples(["a", "b", "c"]), triple_k=2)) == "Context triples: (a, b). Question: Q?"
    assert one(spark, P.append_context(F.lit("Q?"), triples(["a", "b", "c"]), max_triples=0)) == "Q?"


def test_prompts(spark):
    want = "You are answering a medical VQA question.\nReturn ONLY the final answer.\n- Keep it short: 1 to 4 words.\n- No explanations, no full sentences.\n- If yes/no: output exactly 'yes' or 'no'.\n- If a number: output only the number (and unit only if needed).\nQuestion: What?"
    assert one(spark, P.open_text(col()), t="What?") == want
    assert one(spark, P.closed_text(col(), F.lit(""), F.array(F.lit("a"), F.lit(" b ")))  , t=" Q ") == "Question: Q\nOptions: a; b\nAnswer:"
    assert one(spark, P.image_tokens(P.build_prompt(col(), "v1")), t="Q") == 1
    r = lambda name, *m: one(spark, P.render(F.array(*[F.lit(x).cast("string") for x in m]), name))
    assert r("mistral_instruct", "<image>\nQ", None) == "[INST] <image>\nQ [/INST]"
    assert r("mistral_instruct", "Q", "A") == "[INST] Q [/INST] A </s>"
    assert r("vision_v0", "Q", None).endswith("questions.###Human: Q###Assistant:")
    assert r("default", "Q", None).endswith("instability.\n###Human: Q###Assistant:") and r("default", "Q", None).count("###Human: ") == 2
    assert r("llama_2", "Q", None).startswith("[INST] <<SYS>>\nYou are a helpful, respectful and honest")
    assert r("v1", " Q ", "A").endswith(" USER: Q ASSISTANT: A</s>")
    assert r("mpt", "Q", "A").endswith("<|im_end|><|im_start|>user\nQ<|im_end|><|im_start|>assistant\nA<|im_end|>")
    assert r("plain", "Q", "A") == "Q\nA"
    assert r("vision_llama_2", "Q", None).startswith("[INST] <<SYS>>\nYou are a helpful language")
    assert r("mistral", "Q", "A") == "[INST]  Q [/INST]A</s>"
    assert P.stop_string("v1") == "</s>" and P.stop_string("v0") == "###" and P.stop_string("mistral_instruct") == "</s>"


def test_arrays(spark):
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    m = one(spark, A.label_mask(ids(1, 2, 3, 4, 5, 6), ids(7, 8, 9, 10), 5, 3))
    assert m["labels"] == [-100] * 5 + [7, 8, 9] and m["prompt_truncated"] and m["answer_truncated"] and m["prompt_length"] == 5 and m["answer_length"] == 3
    assert one(spark, A.pad_left(ids(201, 202), F.lit(3), 0)) == [0, 201, 202]
    assert one(spark, A.attention_left(ids(201, 202), F.lit(3))) == [0, 1, 1]
    assert one(spark, A.pad_right(ids(1), F.lit(3), -100)) == [1, -100, -100]
    assert one(spark, A.generated_suffix(ids(0, 1, 2, 3, 101, 102), F.lit(4))) == [101, 102]
    assert one(spark, A.sliding_slices(ids(*range(25)), 10)) == [list(range(20)), list(range(10, 25)), list(range(20, 25))]
    assert -200 in one(spark, A.image_token_ids(F.lit("ab<image>c"), A.char_tokens, 1))
    assert one(spark, A.banned_first_ids(F.array(F.lit("ba"), F.lit("bc"), F.lit("a")), A.char_tokens)) == sorted({ord("b") % 100 + 2, ord("a") % 100 + 2})


def test_tail_chunks_match_a_loop(spark):
    def loop(total, n):
        out, i = [], 0
        while i < total:
            end = i + n if i + 1.5 * n < total else total
            out.append(end - i)
            i = end
        return out

    for total in (1, 3, 4, 5, 6, 7, 9, 10, 11, 14, 15, 16):
        rows = spark.range(total).select(A.tail_chunk(F.col("id"), F.lit(total), 4).alias("c")).groupBy("c").count().orderBy("c").collect()
        assert [r["count"] for r in rows] == loop(total, 4), total


def test_sql_functions(spark):
    from tessella.functions.sql import register

    register(spark)
    row = spark.sql("SELECT normalize_answer(' \\'YES\\'. ') AS n, token_f1('left lung apex', 'Left  lung') AS f, token_f1(null, 'x') AS z, has_option_markers('a vs b') AS m, has_option_markers('organ') AS o").first()
    assert (row.n, round(row.f, 6), row.z, row.m, row.o) == ("yes", 0.8, 0.0, True, False)

    texts = ["Yes", "a.b", "", None, "(No)", "left lung", " x　y "]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    bad = df.filter((F.expr("normalize_answer(a)") != X.normalize_answer(col("a"))) | (F.abs(F.expr("token_f1(a, b)") - X.token_f1(col("a"), col("b"))) > 1e-9))
    assert bad.count() == 0
