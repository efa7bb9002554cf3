"""Same or near-same records across splits.

Weighted cosine join: questions become vectors of term weights (inverse
document frequency over the whole corpus); terms are ordered from rare to
common, and a vector is listed only under the terms before its residual norm
falls under the threshold, which loses no pair; each inverted list joins one
side's vectors with the other's, and a pair is weighed once, by an exact dot
product, under its first shared term, after a bound from the largest weights
has not ruled it out. An exact check then throws out pairs whose remaining
words ask something else.

Frequencies are counted over all questions and held down to KNOWN of a
language's questions; a word rarer than that weighs as much as the rarest that is
held. A rare word is a slip of a common one that is near and far more frequent,
of one of its question's language before others as near; else it is a word of its own, which parts two questions unless the other side
has it too, at most misspelled. As a misspelled rare word can't be looked up, the
lists hold all rare words of a text under one term; the exact dot product weighs
each by itself.

Lists are kept within a block of one image group, one answer and one sequence
of numbers, which a pair must share anyway; exact copies of a text are one
vector, and pairs of texts turn into pairs of records at the end.

Defined cases: a record without a usable image belongs to no group and pairs
with none; null answers agree with each other and with answers of punctuation
only; a null question pairs with none; splits other than train count as
evaluation, a null split as none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, sqrt

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.canonical_values import distance
from tessella.llm.courtesies import POLITE, fold, plain
from tessella.llm.linked_splits import attach, image_groups
from tessella.plans.cut import Scratch, kept
from tessella.plans.shared import Shared
from tessella.plans.spread import spread_join, when_few

THRESHOLD = 0.9
#: A word in so large a share of a language's questions is established: it can't be a slip of another one. Words in KNOWN of them
#: are held with their frequency, so at most (words of a question) / KNOWN for each language.
ESTABLISHED, KNOWN = 0.003, 0.0003
#: A slip is at least so many times rarer than the word it is a slip of.
SLIP = 30
#: A word is one of the languages that use it at most so many times less than the language that uses it most.
OWN = 4
#: Weight, in lists, of the one term that stands for rare words, and of unknown Han characters.
LOOSE, RARE = 0.6, "~"
#: Longer words are never taken for slips; the longest established ones are much shorter.
MOST_LETTERS = 40
#: Words, at most, that only one side has.
SPARE = 2

# Words that carry no meaning of their own, and words of one meaning.
SYNONYMS = [
    ("_view", "image picture photo scan slice view photograph bild foto aufnahme schnitt scan cliché cliche coupe vue imagen escaneo corte vista"),
    ("_usual", "usually typically normally generally commonly meist meistens normalerweise üblicherweise gewöhnlich regel habitude habituellement généralement normalmente generalmente habitualmente general général"),
    ("_what", "what which welche welcher welches welchen was quel quelle quels quelles qué que cuál cual"),
    ("_wide", "wide broad"),
    ("_near", "close near nearby beside next"),
    ("_might", "might could may can könnte kann peut pourrait podría puede"),
    ("_shown", "displayed shown visible seen depicted see gezeigt gezeigten dargestellt abgebildet affichée montrée représenté montré mostrado mostrada muestra"),
    ("_see", "erkennen sehen voit voir distingue ve ver aprecia"),
    ("_lies", "lies is located situated liegt besteht befindet trouve situé est hay está"),
    ("_appears", "appear appears erscheint zeigt apparaît aparece"),
    ("_brighter", "than compared with to"),
    ("_used", "used employed applied verwendet benutzt eingesetzt employée utilisée empleó utilizó usó"),
    ("_role", "task role function job aufgabe funktion rolle rôle fonction tarea función papel"),
    ("_treated", "treated managed behandelt therapiert"),
    ("_larger", "larger bigger größer"),
    ("_many", "many"),
]
STOP = set(
    "a an the this that these of in on at by for and it its there do does did one "
    "der die das den dem des ein eine einen einem einer dieser diese dieses diesem diesen im am auf es sich vor und für "
    "le la les l un une des du de d ce cette cet ces sur dans en on y a t il elle se qu qui où "
    "el los las un una unos del este esta estos en se al lo y".split()
)
HAN_SAME = [("什么样的", "什么"), ("哪一种", "什么"), ("哪种", "什么"), ("哪一个", "哪个"), ("多少", "几"), ("周边", "附近"), ("周围", "附近"), ("图像", "图"), ("图片", "图"), ("片子", "图"), ("照片", "图"), ("扫描图", "图"), ("影像", "图"), ("切片", "图"), ("一般", "通常"), ("可以看到", "能看到"), ("可看到", "能看到"), ("看得到", "能看到"), ("较", "比"), ("担任", "承担"), ("起到", "承担"), ("看上去", "看起来"), ("看来", "看起来"), ("一下", ""), ("一张", "")]
HAN_STOP = set("的呢吗了是这那该幅张里中内上处所示个请么啊吧之有一")

_HAN_FIRST = regex.compile(r"\p{Han}").match
_TOKENS = regex.compile(r"\p{Han}|\p{N}+|[\p{Latin}\p{M}]+|[\p{L}\p{M}]+")


#: Common words that tell a language by themselves.
TONGUES = {
    "en": "the is are what which where how does in of this that and", "de": "der die das ist was welche welches wo wie im auf wenn ein eine und zu",
    "fr": "le la les est quel quelle où comment dans sur ce cette une qui voit on", "es": "el los las está hay qué dónde cómo en se del esta este una",
}
_TONGUES = {lang: set(words.split()) for lang, words in TONGUES.items()}
_SAME = {fold(w): name for name, words in SYNONYMS for w in words.split()}
_STOP = {fold(w) for w in STOP}


def tokens(question: str) -> list[str]:
    x = plain(question)
    for a, b in HAN_SAME:
        if a in x:
            x = x.replace(a, b)
    return [fold(t) for t in _TOKENS.findall(x)]


def tongue(question: str) -> str | None:
    """The language whose common words a text in Latin letters has most of, if one leads clearly."""
    words = _TOKENS.findall(question.lower())
    hits = sorted(((sum(w in known for w in words), lang) for lang, known in _TONGUES.items()), reverse=True)
    return hits[0][1] if hits[0][0] >= hits[1][0] + 2 else None


class Vectors:
    """Turns questions into weighted terms, with the corpus's document frequencies: of established words, and of rarer known ones; and the languages of established words."""

    def __init__(self, df: dict[str, int], n: int, known: dict[str, int] | None = None, langs: dict[str, frozenset[str]] | None = None):
        self.df, self.n, self.known, self.langs = df, max(1, n), known or {}, langs or {}
        self.cut: dict[str, list[str]] = {}
        # words of no meaning of their own have slips too
        for w in {**df, **dict.fromkeys([*_STOP, *_SAME, *map(fold, POLITE)], 0)}:
            if len(w) > 3 and not regex.search(r"\p{Han}|\p{N}", w):
                for x in self._shorter(w):
                    self.cut.setdefault(x, []).append(w)
        self.rarest = max([2.0, *map(self.weight, df), *map(self.weight, self.known)])
        self.term = lru_cache(200_000)(self._term)
        self.of = lru_cache(100_000)(self._of)

    @staticmethod
    def _shorter(w: str) -> set[str]:
        """The word with up to one letter left out, up to two in words of six or more; words that near share one."""
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        two = {x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) > 5 else set()
        return {w} | one | two

    def where(self, words: list[str]) -> frozenset[str]:
        """The languages that most of the established words have."""
        hits = Counter(lang for t in words for lang in self.langs.get(t, ()))
        return frozenset(lang for lang, n in hits.items() if n == max(hits.values()))

    def near(self, t: str, where: frozenset[str] = frozenset()) -> str | None:
        """The established word, or the one without meaning, that t is most likely a slip of in a text of these languages; none if t is too frequent for that."""
        if len(t) > MOST_LETTERS:
            return None
        most = 1 if len(t) < 6 else 2
        seen = {w for x in self._shorter(t) for w in self.cut.get(x, ())}
        seen = {w for w in seen if w not in self.df or self.known.get(t, 0) * SLIP <= self.df[w]}
        foreign = {w for w in seen if where and w in self.langs and not where & self.langs[w]}
        got = [(d + (0.5 if w[0] != t[0] else 0), w in foreign, abs(len(w) - len(t)), w) for w in seen if (d := distance(t, w, most)) <= most]
        return min(got)[3] if got else None

    def _term(self, t: str, where: frozenset[str] = frozenset()) -> tuple[str, float] | None:
        """The term and weight of a token; a slip counts as the word it is nearest to, a rare word of its own weighs most."""
        if regex.match(r"\p{N}", t):
            return None  # numbers are in the block's key
        if regex.match(r"\p{Han}", t):
            return None if t in HAN_STOP else (t, self.weight(t))
        if t not in self.df and t not in _STOP and t not in _SAME and t not in POLITE:
            if len(t) > 3:
                t = self.near(t, where) or t
            else:
                short = [w for w in self.df if len(w) <= 4 and abs(len(w) - len(t)) <= 1 and self.known.get(t, 0) * SLIP <= self.df[w] and distance(w, t) == 1]
                if short:
                    t = max(short, key=self.df.get)
        if t in _SAME:
            return (_SAME[t], 0.0)
        if t in _STOP or t in POLITE:
            return None
        return (t, self.weight(t)) if t in self.df or t in self.known else (t, self.rarest)

    def weight(self, t: str) -> float:
        n = self.df.get(t) or self.known.get(t)
        return max(0.2, log(self.n / n)) if n else LOOSE

    def rare(self, t: str) -> bool:
        return t not in self.df and t[0] != "_" and not _HAN_FIRST(t)

    def _of(self, question: str) -> tuple[tuple[str, ...], tuple[float, ...], dict[str, float]]:
        """Terms and weights of length one, from rare to common, as they are listed; and the weights of all words by themselves."""
        exact: dict[str, float] = {}
        words = tokens(question)
        where = self.where(words)
        for t in words:
            if (x := self.term(t, where)) is not None:
                exact[x[0]] = x[1] or 0.3
        got: dict[str, float] = {}
        for t, w in exact.items():
            got[RARE if self.rare(t) else t] = LOOSE if self.rare(t) else w
        size = sqrt(sum(w * w for w in got.values())) or 1.0
        order = sorted(got, key=lambda t: (-got[t], t))
        return tuple(order), tuple(got[t] / size for t in order), exact

    def listed(self, weights: tuple[float, ...]) -> int:
        """How many first terms a vector must be listed under."""
        rest = 1.0
        for k, w in enumerate(weights):
            if rest < THRESHOLD * THRESHOLD - 1e-9:
                return k
            rest -= w * w
        return len(weights)

    def slips(self, only_a: list[str], only_b: list[str]) -> list[tuple[str, str]]:
        """Rare words of both sides that are spellings of one; two known words never are."""
        got, left = [], [t for t in only_b if self.rare(t)]
        for t in only_a:
            near = [(d, u) for u in left if self.rare(t) and not (t in self.known and u in self.known) and (d := distance(t, u, 2)) <= (1 if min(len(t), len(u)) < 6 else 2)]
            if near:
                u = min(near)[1]
                got.append((t, u))
                left.remove(u)
        return got

    def cosine(self, a: str, b: str) -> float:
        """The exact cosine of two questions whose vectors met, 0 if what only one side has asks something else.

        What one side alone has may be words of one meaning, or up to SPARE unknown Han characters.
        """
        wa, wb = self.of(a)[2], self.of(b)[2]
        if (la := tongue(a)) and (lb := tongue(b)) and la != lb:
            return 0.0  # a translation
        only_a, only_b = [t for t in wa if t not in wb], [t for t in wb if t not in wa]
        pairs = self.slips(only_a, only_b)
        only_a, only_b = [t for t in only_a if t not in {p[0] for p in pairs}], [t for t in only_b if t not in {p[1] for p in pairs}]
        spare_a, spare_b = [t for t in only_a if t[0] != "_"], [t for t in only_b if t[0] != "_"]
        if spare_a and spare_b or len(spare_a + spare_b) > SPARE or any(not _HAN_FIRST(t) or t in self.df or t in self.known for t in spare_a + spare_b):
            return 0.0
        dot = sum(w * wb[t] for t, w in wa.items() if t in wb) + sum(wa[t] * wb[u] for t, u in pairs)
        return dot / sqrt(sum(w * w for w in wa.values()) * sum(w * w for w in wb.values())) if dot else 0.0


_READY: dict[str, Vectors] = {}


def _vectors(shared: Shared) -> Vectors:
    if shared.name not in _READY:
        _READY.clear()
        _READY[shared.name] = Vectors(*shared.value)
    return _READY[shared.name]


def _texts(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Written table (rec_id, train, block, tid, question, lang) of all records that can pair; tid tells texts that differ in more than marks apart."""
    pairs, _ = image_groups(records, scratch)
    answer = F.regexp_replace(F.lower(F.coalesce("answer", F.lit(""))), r"[\p{P}\s_]+", "")
    spaced = F.trim(F.regexp_replace(F.lower("question"), r"(?U)[\p{P}\s_]+", " "))
    numbers = F.array_join(F.regexp_extract_all("question", F.lit(r"(\d+)"), F.lit(1)), ",")
    rows = records.filter("question is not null and split is not null").select("rec_id", "img_id", "img_name", (F.lower("split") == "train").alias("train"), F.xxhash64(answer, numbers).alias("key"), F.xxhash64(spaced).alias("tid"), "question", F.lower(F.substring(F.trim("q_lang"), 1, 2)).alias("lang"))
    rows = attach(rows, scratch.keep(pairs.select("img_id", "img_name", "n", "group_id")), ["group_id"])
    return scratch.keep(rows.select("rec_id", "train", F.xxhash64("group_id", "key").alias("block"), "tid", "question", "lang"))


def _frequencies(texts: DataFrame) -> tuple[dict[str, int], int, dict[str, int], dict[str, frozenset[str]]]:
    """Document frequencies of the established words, the number of questions, frequencies of the other known words, and the languages of the established ones.

    Every known word holds at least KNOWN of its language's questions, so there
    are at most (words per question) / KNOWN of them per language.
    """
    folded = F.translate(F.lower("question"), "àâäáãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    token = F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(r"(\p{IsHan}|[\p{L}\p{M}]+)"), F.lit(1)))).alias("w")
    lang = F.when(F.col("lang").isin("en", "zh", "de", "fr", "es"), F.col("lang")).otherwise("")
    counts = texts.select(lang.alias("lang"), token).groupBy("lang", "w").agg(F.count("*").alias("n"))
    per = texts.groupBy(lang.alias("lang")).agg(F.count("*").alias("of")).collect()  # at most six rows
    # questions of no known label are held to a share of their own number too, or slips would become words as the table grows
    of = F.lit(None).cast("double")
    for r in per:
        of = F.when(F.col("lang") == r["lang"], float(r["of"])).otherwise(of)
    kept = lambda share: F.coalesce(F.max(F.col("n") >= F.greatest(F.lit(8.0), of * share)), F.lit(False))
    shares = F.struct(F.lit(0.0).alias(""), *[F.max(F.when(F.col("lang") == r["lang"], F.col("n") / of)).alias(r["lang"]) for r in per if r["lang"]])
    total = counts.groupBy("w").agg(F.sum("n").alias("n"), kept(ESTABLISHED).alias("established"), kept(KNOWN).alias("known"), shares.alias("shares")).filter("known").collect()
    # wrong labels put a small share of a word into other languages
    langs = {r["w"]: frozenset(k for k, x in r["shares"].asDict().items() if x and x * OWN >= max(y or 0.0 for y in r["shares"])) for r in total if r["established"]}
    return {r["w"]: r["n"] for r in total if r["established"]}, sum(r["of"] for r in per), {r["w"]: r["n"] for r in total if not r["established"]}, langs


def overlaps(records: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts (block, tid_a, tid_b, cosine), a of train and b not, and the membership (rec_id, train, block, tid)."""
    spark = records.sparkSession
    scratch = scratch or Scratch(spark, "overlap")
    rows = _texts(records, scratch)
    shared = Shared(spark, _frequencies(rows))
    # only blocks with both sides and more than one text can hold a near pair; exact copies are one vector
    sides = rows.groupBy("block").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("e"), F.min("tid").alias("lo"), F.max("tid").alias("hi")).filter("t and e and lo <> hi").select("block")
    near = rows.select("block", "tid", "train", "question").join(when_few(scratch.keep(sides)), "block", "left_semi").dropDuplicates(["block", "tid", "train"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vectors(shared)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for block, tid, train, q in zip(*(x.to_pylist() for x in b.columns)):
                terms, weights, _ = v.of(q)
                for k in range(v.listed(weights)):
                    for o, x in zip(out, (block, terms[k], tid, train, q, weights[0], sum(weights))):
                        o.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["block", "term", "tid", "train", "question", "most", "total"])

    listed = scratch.keep(near.mapInArrow(build, "block bigint, term string, tid bigint, train boolean, question string, most double, total double"))
    side = lambda name, which: listed.filter(which).select("block", "term", *[F.col(c).alias(f"{c}_{name}") for c in ("tid", "question", "most", "total")])
    # the lists of a hot block are spread
    right = scratch.keep(side("b", "not train"))
    met = spread_join(side("a", "train"), right, ["block", "term"], None, F.col("tid_a"), ["tid_b", "question_b", "most_b", "total_b"]).filter("tid_a <> tid_b")
    # bound by the largest weights: the dot product is at most either largest weight times the other's sum
    met = met.filter(F.least(F.col("most_a") * F.col("total_b"), F.col("most_b") * F.col("total_a")) >= THRESHOLD)
    met = met.select("block", "term", "tid_a", "tid_b", "question_a", "question_b")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vectors(shared)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for block, term, ia, ib, qa, qb in zip(*(x.to_pylist() for x in batch.columns)):
                (ta, wa, _), (tb, wb, _) = v.of(qa), v.of(qb)
                of_b = dict(zip(tb, wb))
                if next(t for t in ta if t in of_b) != term:
                    continue  # weighed under its first shared term
                dot = sum(w * of_b[t] for t, w in zip(ta, wa) if t in of_b)
                if dot >= THRESHOLD and (exact := v.cosine(qa, qb)) >= THRESHOLD:
                    for o, x in zip(out, (block, ia, ib, exact)):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["block", "tid_a", "tid_b", "cosine"])

    pairs = met.mapInArrow(weigh, "block bigint, tid_a bigint, tid_b bigint, cosine double")
    # a text that both sides have pairs with itself
    own = rows.groupBy("block", "tid").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("e")).filter("t and e").select("block", F.col("tid").alias("tid_a"), F.col("tid").alias("tid_b"), F.lit(1.0).alias("cosine"))
    return scratch.keep(pairs.union(own)), rows.select("rec_id", "train", "block", "tid")


def found(records: DataFrame) -> DataFrame:
    """(rec_id_a, rec_id_b), the smaller first: every pair of a train record with one of another split."""
    pairs, rows = overlaps(records)
    # both joins spread the copies of a hot text
    b = kept(spread_join(rows.filter("not train"), pairs, ["block", ("tid", "tid_b")], None, F.col("rec_id"), ["tid_a"]).select("block", "tid_a", F.col("rec_id").alias("rb")), "overlap")
    got = spread_join(rows.filter("train").select(F.col("rec_id").alias("ra"), "block", "tid"), b, ["block", ("tid", "tid_a")], None, F.col("ra"), ["rb"])
    return got.select(F.least("ra", "rb").alias("rec_id_a"), F.greatest("ra", "rb").alias("rec_id_b"))


def _linked(records: DataFrame) -> DataFrame:
    """(rec_id, train, block, tid, links) of every record that overlaps with the other side."""
    pairs, rows = overlaps(records)
    copies = rows.groupBy("block", "tid").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e"))
    counted = kept(spread_join(pairs, copies.select("block", F.col("tid").alias("tid_a"), "t"), ["block", "tid_a"], None, F.col("tid_b"), ["t"]), "overlap")
    counted = kept(spread_join(counted, copies.select("block", F.col("tid").alias("tid_b"), "e"), ["block", "tid_b"], None, F.col("tid_a"), ["e"]), "overlap")
    links = counted.select("block", F.lit(True).alias("train"), F.col("tid_a").alias("tid"), F.col("e").alias("links")).union(counted.select("block", F.lit(False), "tid_b", "t")).groupBy("block", "train", "tid").agg(F.sum("links").alias("links"))
    return spread_join(rows, links, ["block", "train", "tid"], None, F.col("rec_id"), ["links"])


def members(records: DataFrame) -> DataFrame:
    """(rec_id, class_id, links): every record that overlaps with the other side, the smallest such rec_id of its block with its text, and its number of links; no pair of copies is written out."""
    hit = kept(_linked(records), "overlap")
    classes = hit.groupBy("block", "tid").agg(F.min("rec_id").alias("class_id"))
    return spread_join(hit, classes, ["block", "tid"], None, F.col("rec_id"), ["class_id"]).select("rec_id", "class_id", "links")


def report(records: DataFrame) -> DataFrame:
    """(split, source, records, links): evaluation records that overlap with train, and their links, per split and source."""
    hit = _linked(records).filter("not train").select("rec_id", "links")
    named = spread_join(records.select("rec_id", "split", "source"), hit, ["rec_id"], None, F.col("rec_id"), ["links"])
    return named.groupBy("split", "source").agg(F.count("*").alias("records"), F.sum("links").alias("links"))
