"""Broken question and answer pairs.

Ordered rules flag every defect of an answer: empty, copy of the question,
refusal, truncated, other_language. Abrupt endings are told by marks (unclosed
delimiters, trailing ellipsis or hyphen, a dangling joiner) and by statistics
over all answers: an answer breaks off if the words it ends with hardly ever end
an answer but go on elsewhere, or if its last word is the beginning of the word
that follows there. The language of an answer is weighed by the linear machines
of ``languages`` against each language of its question.

Defined cases: a null or blank answer is empty, whatever the question; a null
question can't be copied and has no language, so only the other rules apply;
numbers, measures and technique names belong to every language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.courtesies import plain
from tessella.llm.languages import Classifier, Machines, classifier, label_column, train
from tessella.plans.cut import Scratch, measure
from tessella.plans.shared import Shared
from tessella.plans.spread import BROADCAST_BYTES, spread_join

#: Order in which the first defect is named.
ORDER = ["empty", "copy", "refusal", "truncated", "other_language"]
#: A context that is followed by more at least LEAST times ends at most ENDS of its answers where they break off;
#: a broken word is LONGER times rarer than the longer words it begins.
LEAST, ENDS, LONGER = 12, 0.04, 12
#: Answers of so many words at most that are given so often are judged by whose questions usually get them.
SHORT_WORDS, OFTEN, USUAL = 3, 5, 0.2
#: Answers with statistics are broadcast up to this number, beyond it joined.
BROADCAST_ROWS = 100_000
#: Shares of matching letters from which an answer is the question again, one that ends as a question and any other.
ASKS_SAME, NEARLY_SAME = 0.68, 0.82
#: Texts of more letters are weighed by the shingles of so many letters they share, in linear time, and are the same from this share on.
LONG, SHINGLE, SHARED_SHINGLES = 1000, 8, 0.5
#: Questions and answers that a worker keeps; beyond that it starts afresh.
KEEP = 150_000
#: Scaled margins beyond which an answer isn't in a language: for one word, for two, for more.
MARGINS = (1.2, 0.8, 0.5)

# Placeholders, markers, joiners, names of techniques and units, refusals.
PLACEHOLDERS = set("none null nil nan n/a na n.a n.a. nv tbd todo undefined missing unknown unbekannt inconnu desconocido nichts empty blank (none) (null) <none> <null> 无答案 未知 空 缺失 暂无 待定".split()) | {"no answer", "not available", "not given", "no value", "keine angabe", "sans réponse", "sin respuesta"}
MARKERS = regex.compile(r"^(?:\s*(?:[>#*\-–—]|(?:q|a|question|answer|the question is|you asked|your question|frage|antwort|réponse|respuesta|pregunta|问|答|问题|回答)\s*[:：]))+", regex.I)
DANGLING = set(
    "a an the of and or but which who because although unless if whose than nor "
    "der die das den dem des ein eine einen einem einer und oder aber dass weil obwohl während sofern sowie "
    "le la les un une des du de et ou mais que qui car parce pour avec dans sur aux sauf "
    "el los las un una unos unas del y o pero porque aunque mientras para con en por salvo".split()
)
EVERYWHERE = set("mm cm m ml hu t1 t2 flair x-ray xray x ray mri ct pet mr us dwi adc suv kv kvp mas msv rgb dicom png vhead ktail ok a b c d".split())
REFUSALS = regex.compile(
    "|".join(
        [
            r"\bas an? (?:ai|(?:large )?language model|assistant)\b", r"\bi(?:'m| am)?(?: (?:am|must|have to|need to|would))*(?: sorry| apologi[sz]e| not able to| unable to| decline\b| can(?:no|')?t (?:answer|help|give|provide|comment|interpret|assist|say|discuss)| refuse\b| won'?t\b| will not\b)",
            r"\b(?:decline to|not able to (?:answer|interpret|comment|provide|help)|unable to (?:answer|interpret|comment|provide|help|assist))", r"\boutside what i (?:may|can)\b", r"\bwould not be appropriate for me\b", r"\bapologies\b", r"\bcannot (?:answer|help|assist|comment|provide)\b",
            r"\b(?:consult|see|ask(?:ing)?) a (?:qualified |medical )?(?:clinician|specialist|doctor|physician|professional)\b",
            r"\bals (?:ki|sprachmodell|ein sprachmodell)\b", r"\b(?:es )?tut mir leid\b", r"\bich (?:kann|darf|muss|möchte|werde)\b.{0,40}(?:nicht|keine|ablehnen)", r"\b(?:kann|darf) ich\b.{0,60}(?:nicht|keine)", r"\banfrage ablehnen\b", r"\bkeine auskunft\b", r"\bfragen sie (?:bitte )?(?:eine|einen|ihren) (?:fachperson|arzt|ärztin|facharzt)",
            r"\ben tant que (?:modèle|ia|assistant)\b", r"\bje (?:suis désolée?|ne peux pas|ne suis pas en mesure|dois refuser|refuse|regrette)\b", r"\bil ne m'est pas (?:permis|possible)\b", r"\brefuser cette demande\b", r"\bveuillez consulter\b",
            r"\bcomo (?:modelo|ia|asistente|un modelo)\b", r"\blo siento\b", r"\bno (?:puedo|me (?:está permitido|es posible)|estoy (?:autorizad[oa]|en condiciones)|debo) ", r"\bdebo (?:rechazar|declinar)\b", r"\bdisculpe\b", r"\bconsulte a un\b",
            # a preference, a rule, somebody else's place, another topic
            r"\b(?:i'?d|i would|i) (?:rather|prefer)\b.{0,20}\bnot\b", r"\bno comment\b", r"\b(?:guidelines?|rules|polic(?:y|ies)|instructions)\b.{0,20}\b(?:do(?:es)? not|don'?t|doesn'?t|won'?t|cannot|forbid|prohibit|prevent)", r"\b(?:isn'?t|is not|not) (?:my place|for me|up to me) to\b",
            r"\bonly an? (?:qualified |medical )?(?:doctor|physician|clinician|specialist|radiologist|professional) (?:should|can|may|could)\b", r"\b(?:have|need|ought) to ask (?:the|your|a) (?:\w+ )?(?:doctor|physician|clinician|specialist|radiologist)", r"\b(?:let'?s|let us|shall we|can we|we could) (?:talk|speak|chat) about (?:something|anything) else\b|\bchange the subject\b",
            r"\bnur (?:ein|eine|ihr|ihre) (?:facharzt|arzt|ärztin|fachärztin|radiologe|fachperson)\b", r"\b(?:möchte|will|werde) ich mich nicht äußern\b|\bich mich (?:dazu )?(?:lieber )?nicht äußern\b", r"\b(?:richtlinien|regeln|vorgaben|vorschriften)\b.{0,30}\b(?:kein|keine|nicht|verbieten|untersagen)\b", r"\bkein kommentar\b", r"\bsteht mir nicht zu\b", r"\b(?:reden|sprechen) wir (?:lieber )?(?:über|von) etwas ander", r"\b(?:müssten|müssen|sollten) sie\b.{0,40}\b(?:arzt|ärztin|facharzt|radiologen) fragen\b",
            r"\bseuls? (?:un|une|votre|le) (?:médecin|spécialiste|radiologue|professionnel)\b", r"\bje préfère(?:rais)? ne (?:rien|pas)\b", r"\b(?:consignes|règles|directives|instructions)\b.{0,20}\b(?:interdi|ne .{0,12}permet|empêche)", r"\b(?:sans|pas de) commentaire\b", r"\bce n'est pas à moi de\b", r"\bparlons (?:plutôt )?d'autre chose\b", r"\bil (?:faudrait|faut|vaut mieux) demander (?:au|à (?:un|votre|la)) (?:\w+ )?(?:médecin|radiologue|spécialiste)",
            r"\bs[oó]lo\b.{0,30}\b(?:un|una|su) (?:médic[oa]|especialista|radiólog[oa])\b", r"\bprefiero no\b|\bpreferiría no\b", r"\b(?:normas|reglas|pautas|directrices|instrucciones)\b.{0,20}\b(?:no|prohíben|impiden)\b", r"\bsin comentarios\b", r"\bno me corresponde\b", r"\bhablemos (?:mejor )?de otra cosa\b", r"\b(?:tendría|debería|habría) que preguntar(?:le|lo)?\b|\bdebería preguntar(?:le|lo)? (?:al|a su|a un)",
            r"恕我|恕不|不予置评|无可奉告", r"只有(?:专业)?(?:医生|医师|大夫)才", r"(?:按照|根据|依照)?(?:规定|规则|准则|指引).{0,6}(?:不可以|不能|不允许|不得|禁止)", r"聊(?:点|些)?别的|换个话题", r"问(?:问|一下)?(?:您的|你的)?(?:主治|专科|放射科)?(?:医师|医生|大夫)", r"我(?:不想|宁愿不|还是不)(?:说|回答|评论)",
            r"抱歉", r"对不起", r"不好意思", r"作为(?:一个)?(?:语言模型|人工智能|AI)", r"我(?:无法|不能|不便|没有办法|没法|拒绝)", r"超出了我", r"(?:请|建议您)(?:咨询|询问)专",
        ]
    ),
    regex.I,
)
NOT_REFUSAL = regex.compile(r"^(?:yes|no|ja|nein|oui|non|sí|si|是|否)\s*(?:[,.;:，。；：]|$)", regex.I)

_DIGIT = regex.compile(r"\d")
_WORD = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*(?:['’]\p{Latin}[\p{Latin}\p{M}]*)*")
_HAN = regex.compile(r"\p{Han}")
_SIGN = regex.compile(r"[\p{L}\p{N}]")
_BARE = regex.compile(r"[^\p{L}\p{N}]+")
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»", "{": "}"}
_QUESTION_TAIL = regex.compile(r"[\s\p{P}]*$")


def answer_key(answer: Column) -> Column:
    """An answer in lower case with single spaces, digits as 0, without surrounding marks."""
    x = F.regexp_replace(F.lower(answer), r"(?U)\s+", " ")
    x = F.regexp_replace(x, r"\d+(?:[.,]\d+)*", "0")
    return F.regexp_replace(x, r"^[\p{P}\s]+|[.。!！?？\"'”’»\s*_]+$", "")


def python_key(answer: str) -> str:
    x = regex.sub(r"\s+", " ", answer.lower())
    x = regex.sub(r"[0-9]+(?:[.,][0-9]+)*", "0", x)
    return regex.sub(r"^[\p{P}\s]+|[.。!！?？\"'”’»\s*_]+$", "", x)


def answer_counts(records: DataFrame, column: str, label: str) -> DataFrame:
    """(key, lang, n): how often each answer is given to questions labelled with each language; keys are made once per distinct answer."""
    raw = records.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("a"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    return raw.select(answer_key(F.col("a")).alias("key"), label_column(F.col("l")).alias("lang"), "n").filter("key <> ''").groupBy("key", "lang").agg(F.sum("n").alias("n"))


def broken_off(counts: DataFrame) -> DataFrame:
    """(key): keys of the answers whose last words go on elsewhere, by counts (key, lang, n) over all answers."""
    keys = counts.groupBy("key").agg(F.sum("n").alias("n"))
    tokens = F.regexp_extract_all("key", F.lit(r"(\p{IsHan}|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|\d+)"), F.lit(1))
    split = keys.select("key", "n", F.concat(F.array(F.lit("^"), F.lit("^")), tokens).alias("t")).filter("size(t) > 2")
    at = F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i + 1).alias("w"), F.element_at("t", i).alias("p"), F.element_at("t", i - 1).alias("pp"), (i == F.size("t") - 1).alias("last")))
    long = split.select("key", "n", F.explode(at).alias("x")).select("key", "n", "x.*")
    # a Han character is told by the two before it, a word by the one before it
    context = F.concat_ws(" ", F.when(F.col("w").rlike(r"\p{IsHan}"), F.col("pp")), "p", "w")
    stats = long.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).alias("ends"))
    pairs = long.filter(~F.col("w").rlike(r"\p{IsHan}")).groupBy("p", "w").agg(F.sum("n").alias("n"))
    begun = pairs.filter("length(w) > 1").select("p", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.col("w").substr(F.lit(1), k))).alias("w"), "n").groupBy("p", "w").agg(F.sum("n").alias("longer"))
    tails = long.filter("last").select("key", context.alias("context"), "p", "w")
    got = tails.join(stats, "context").join(pairs.select("p", "w", F.col("n").alias("own")), ["p", "w"], "left").join(begun, ["p", "w"], "left")
    goes_on = (F.col("total") - F.col("ends") >= LEAST) & (F.col("ends") <= ENDS * F.col("total"))
    cut_word = (F.coalesce("longer", F.lit(0)) >= LEAST) & (F.col("longer") >= LONGER * F.col("own"))
    return got.filter(goes_on | cut_word).select("key")


def usual_languages(counts: DataFrame) -> DataFrame:
    """(key, langs): short answers given often, with the languages whose questions often get them.

    By rates within the labelled questions of each language, so that wrong
    labels and answers, being few, don't count.
    """
    keys = counts.filter("lang is not null")
    totals = keys.groupBy("lang").agg(F.sum("n").alias("of"))  # a row per language
    short = keys.filter(F.size(F.split("key", r"[\s']+")) <= SHORT_WORDS)
    rates = short.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("of"))
    top = rates.groupBy("key").agg(F.max("rate").alias("top"), F.sum("n").alias("all"), F.collect_list(F.struct("lang", "rate")).alias("r")).filter(F.col("all") >= OFTEN)
    return top.select("key", F.array_join(F.transform(F.filter("r", lambda x: x["rate"] >= USUAL * F.col("top")), lambda x: x["lang"]), ",").alias("langs"))


def _norm(s: str) -> str:
    return _BARE.sub("", s.lower())


def _bare(text: str) -> str:
    """Letters and digits of a text without markers and courtesies."""
    return _norm(plain(MARKERS.sub("", text)))


def _letter_pairs(text: str) -> frozenset[str]:
    x = _norm(text)
    return frozenset(map(add, x, x[1:]))


def is_empty(answer: str | None) -> bool:
    return answer is None or not _SIGN.search(answer) or answer.strip().strip(".\"'()[]<>").lower() in PLACEHOLDERS or answer.strip().lower() in PLACEHOLDERS


def is_copy(q: str, a: str, answer: str) -> bool:
    """The answer gives the question back, whole or nearly, once or more often, and adds nothing; q and a are their bare letters and digits."""
    if a == q:
        return True
    la, lq = len(a), len(q)
    if la < 6:
        return False
    if la > lq and q in a:
        if la >= 2 * lq - 4 and a.replace(q, "") == "":
            return True
        if la - lq <= 8:
            return la - lq <= (3 if _HAN.search(a) else 8)
    han = bool(_HAN.search(a))
    if la < (6 if han else 15):
        return False
    asks = answer.rstrip(" \t\n\"'”’」)*_").endswith(("?", "？"))
    if max(la, lq) > LONG:
        return 5 * la >= 3 * lq and (a in q or 10 * la <= 14 * lq and _shared(q, a, max(la, lq)) >= SHARED_SHINGLES) or lq > la and asks and _shared(q, a, la) >= 0.8
    if 5 * la >= 3 * lq:
        if a in q:
            return True
        # a question with spelling slips or a word changed; one that still asks may differ more
        least = ASKS_SAME if asks else NEARLY_SAME
        if 10 * la <= 14 * lq and (m := SequenceMatcher(None, q, a, autojunk=False)).real_quick_ratio() > least and m.quick_ratio() > least:
            return m.ratio() > least
    if lq > la >= (8 if han else 20) and answer.rstrip(" \"'”」)*_").endswith(("?", "？")):
        return SequenceMatcher(None, q, a, autojunk=False).find_longest_match(0, lq, 0, la).size >= 0.8 * la
    return False


def _shared(q: str, a: str, of: int) -> float:
    """Share of the shingles of a text of so many letters that q and a have in common, each as often as both have it."""
    count = lambda x: Counter(x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1))
    return (count(q) & count(a)).total() / max(1, of - SHINGLE + 1)


def is_refusal(answer: str) -> bool:
    return bool(REFUSALS.search(answer)) and not NOT_REFUSAL.match(answer.strip())


def is_cut(answer: str) -> bool:
    """Abrupt by its own marks."""
    s = answer.rstrip(" \t\r\n\u3000\xa0")
    if s.endswith(("…", "...")):
        return True
    t = s.rstrip("\"'”’»*_")
    if len(t) > 1 and t[-1] in "-‐‑–" and t[-2].isalpha():
        return True
    if t and t[-1] in ",、，;；:：(（":
        return True
    for o, c in _PAIRS.items():
        if o in s and s.count(o) > s.count(c):
            return True
    words = _WORD.findall(s.lower())
    return len(words) >= 4 and words[-1] in DANGLING and s.rstrip(".").lower().endswith(words[-1]) and not s.endswith(".")


def answer_languages(c: Classifier, answer: str, usual: str | None = None) -> tuple[str | None, dict[str, bool]]:
    """Script of an answer ("han", "latin" or None for neither), and whether it is foreign to each Latin language."""
    han = len(_HAN.findall(answer))
    words = [w for w in _WORD.findall(answer.lower()) if w not in EVERYWHERE]
    if han:
        return ("han" if han >= len(words) else None), {}
    if not words or all(len(w) == 1 for w in words):
        return None, {}
    if usual:
        return "latin", {lang: lang not in usual.split(",") for lang in c.langs}
    return "latin", {lang: c.fit_of(words, lang) < -MARGINS[min(len(words), 3) - 1] for lang in c.langs}


class Checker:
    """Finds defects, keeping what it knows of questions and of answers apart from each other."""

    def __init__(self, c: Classifier):
        self.c = c
        self.questions: dict[str, list] = {}
        self.answers: dict[str, tuple] = {}

    def question(self, q: str) -> list:
        """Languages, then letter pairs and bare text, which are made when an answer first needs them."""
        got = self.questions.get(q)
        if got is None:
            if len(self.questions) > KEEP:
                self.questions.clear()
            got = self.questions[q] = [frozenset(s[0] for s in self.c.segments(q)), None, None]
        return got

    def answer(self, a: str, cut: bool, usual: str | None) -> tuple:
        got = self.answers.get(a)
        if got is None:
            if len(self.answers) > KEEP:
                self.answers.clear()
            if is_empty(a):
                got = (True,)
            else:
                got = (False, _letter_pairs(a), _bare(a), is_refusal(a), cut or is_cut(a), *answer_languages(self.c, a, usual))
            self.answers[a] = got
        return got

    def defects(self, question: str | None, answer: str | None, cut: bool = False, usual: str | None = None) -> list[str]:
        """Every defect of one answer, in ORDER; cut: the statistics call it broken off; usual: languages that it is usual in."""
        if answer is None:
            return ["empty"]
        got = self.answer(answer, cut, usual)
        if got[0]:
            return ["empty"]
        _, pairs, a, refusal, short, script, foreign = got
        of = self.question(question) if question else None
        out = []
        if of and len(pairs) > 3:
            if of[1] is None:
                of[1] = _letter_pairs(question)
            # most letter pairs of a copy are the question's
            if 2 * len(pairs & of[1]) >= len(pairs):
                if of[2] is None:
                    of[2] = _bare(question)
                if of[2] and is_copy(of[2], a, answer):
                    out.append("copy")
        elif of and a and len(question) < 4 * len(answer) and a == _bare(question):
            out.append("copy")
        if refusal:
            out.append("refusal")
        if short:
            out.append("truncated")
        langs = of[0] if of else ()
        if langs and (script == "han" and "zh" not in langs or script == "latin" and all(foreign.get(x, True) for x in langs)):
            out.append("other_language")
        return out


_READY: dict[str, Checker] = {}


def _checker(shared: Shared) -> Checker:
    if shared.name not in _READY:
        _READY.clear()
        _READY[shared.name] = Checker(classifier(shared))
    return _READY[shared.name]


def all_defects(records: DataFrame, machines: Machines | None = None, first_only: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(rec_id, defect): every defect of every answer, or only its first in ORDER."""
    spark = records.sparkSession
    shared = Shared(spark, machines or train(records, ["question", "answer"], "q_lang"))
    scratch = Scratch(spark, "answers")
    counts = scratch.keep(answer_counts(records, "answer", "q_lang"))
    cut = broken_off(counts).select("key", F.lit(True).alias("cut"), F.lit(None).cast("string").alias("usual"))
    usual = usual_languages(counts).select("key", F.lit(None).cast("boolean").alias("cut"), F.col("langs").alias("usual"))
    known = scratch.keep(cut.union(usual).groupBy("key").agg(F.coalesce(F.max("cut"), F.lit(False)).alias("cut"), F.max("usual").alias("usual")))
    rows = records.select("rec_id", "question", "answer")
    held, size = measure(known)
    if held <= broadcast_rows and size <= BROADCAST_BYTES:
        keys = Shared(spark, {r["key"]: (r["cut"], r["usual"]) for r in known.collect()})
        rows = rows.select("*", F.lit(None).cast("boolean").alias("cut"), F.lit(None).cast("string").alias("usual"))
    else:
        keys = None
        # an answer that a third of the records have is spread over tasks
        joined = spread_join(rows.withColumn("_key", answer_key(F.col("answer"))), known, [("_key", "key")], None, F.col("rec_id"), [("cut", "_cut"), ("usual", "_usual")], "left", broadcast_rows=0)
        rows = joined.select("rec_id", "question", "answer", F.coalesce("_cut", F.lit(False)).alias("cut"), F.col("_usual").alias("usual"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = _checker(shared)
        table = keys.value if keys else {}
        for b in batches:
            rec, got = [], []
            for r, q, a, k, u in zip(*(x.to_pylist() for x in b.columns)):
                # digits tell nothing here but in copies, and there they follow the words
                q, a = _DIGIT.sub("0", q) if q else q, _DIGIT.sub("0", a) if a else a
                if keys and a is not None and a not in check.answers:
                    k, u = table.get(python_key(a), (False, None))
                d = check.defects(q, a, bool(k), u)
                for x in d[:1] if first_only else d:
                    rec.append(r)
                    got.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(got, pa.string())], names=["rec_id", "defect"])

    return rows.mapInArrow(run, "rec_id bigint, defect string")


def found(records: DataFrame) -> DataFrame:
    """(rec_id, defect): one row per defective answer."""
    return all_defects(records, first_only=True)
