"""Missing or wrong language labels, and segments of texts that mix languages.

Hierarchical discrimination: the script, and for texts in Latin letters linear
support vector machines between language families, give the family; one-versus-
one linear support vector machines separate the languages within it. Features
are whole words and their character n-grams, averaged over the words of a text,
so a text's margin is the mean of per-word scores that workers keep.

The machines are fitted on the driver on a bounded sample of labelled rows
(SAMPLE_ROWS, a parameter), chosen by a hash of their texts, so the same table
gives the same machines however it is laid out; every row is classified.

Defined cases: a text without letters has no language and no segments; a text in
a script of its own gets the script's usual language, one in a script not listed
and one that the machines tell with less than UNSURE get UNKNOWN; an unknown or
blank label is missing; words in brackets, single foreign words and greetings
make no segment of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.courtesies import POLITE, fold
from tessella.plans.shared import Shared

#: Labelled rows that the machines are fitted on, at most.
SAMPLE_ROWS = 30_000
FAMILIES = {"germanic": ("en", "de"), "romance": ("fr", "es")}
#: Languages told by their script: letters of the script, whether words are parted by spaces, and the confidence that the script's usual language is meant.
SCRIPTS = {
    "zh": (r"\p{Han}", False, 0.9), "ja": (r"[\p{Hiragana}\p{Katakana}]", False, 0.9), "th": (r"\p{Thai}", False, 0.9), "ko": (r"\p{Hangul}", True, 0.9), "el": (r"\p{Greek}", True, 0.9), "he": (r"\p{Hebrew}", True, 0.9),
    "hi": (r"\p{Devanagari}", True, 0.6), "ru": (r"\p{Cyrillic}", True, 0.6), "ar": (r"\p{Arabic}", True, 0.6),
}
#: What is called of no known language, and the confidence of the machines under which a text is.
UNKNOWN, UNSURE = "und", 0.4
BUCKETS = 1 << 16
#: Words that a part needs to count as a language of its own; Han characters likewise.
LEAST_WORDS, LEAST_HAN = 3, 5
#: Clauses of less confidence go with their neighbour.
DOUBT = 0.45
KEEP = 150_000

# Names of languages in labels.
NAMES = {
    "en": "en eng english", "zh": "zh zho chi cmn chinese mandarin", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian",
    "ja": "ja jpn japanese", "pt": "pt por portuguese", "it": "it ita italian", "nl": "nl nld dut dutch", "hi": "hi hin hindi", "th": "th tha thai", "ko": "ko kor korean", "ru": "ru rus russian", "ar": "ar ara arabic", "el": "el ell gre greek", "he": "he heb hebrew",
}
#: Common words of each language; each counts as one labelled text when the machines are fitted.
COMMON = {
    "en": "the of and to in is was are were that this it for on with as be by at from have has had not but or an they we you he she which what who how when where there their if will would can could should than then only also into over after before first one two more most some any no very please thank thanks was here",
    "de": "der die das den dem des und in zu mit sich auf für ist im nicht ein eine einem einen einer als auch es an werden aus er hat dass sie nach wird bei noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können hier bitte danke wir uns ich du was wo wer nur zuerst",
    "fr": "le la les de des du un une et à est en que qui dans pour pas sur au aux avec il elle ne se ce cette ces son sa ses plus par je nous vous ils elles on mais ou où si leur y être avoir été était ont sont fait comme tout très bien aussi sans sous entre après avant seulement merci",
    "es": "el la los las de del un una y a en que es por con no para se su lo como más pero sus le al este esta estos entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos fue son era está están gracias por favor sólo solo primero mire",
}
_NAMED = {n: code for code, names in NAMES.items() for n in names.split()}

_WORD = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*(?:['’]\p{Latin}[\p{Latin}\p{M}]*)*")
_HAN = regex.compile(r"\p{Han}")
_OTHER = regex.compile(r"[\p{L}--\p{Latin}--\p{Han}]", regex.V1)
_UNITS = {lang: regex.compile(rf"{x}[{x}\p{{M}}]*" if spaced else x, regex.V1) for lang, (x, spaced, _) in SCRIPTS.items()}
_UNLISTED = regex.compile("[\\p{L}--\\p{Latin}" + "".join(f"--{x}" for x, _, _ in SCRIPTS.values()) + "][\\p{L}\\p{M}]*", regex.V1)
_DIGITS = regex.compile(r"\d+")
_BRACKETS = regex.compile(r"[(（\[][^()（）\[\]]{0,60}[)）\]]")
#: Ends of parts: sentence ends, spaced separators, line breaks, then commas and colons as weak ends.
_STRONG = regex.compile(r"[.!?…؟]+[\"'”»)\]*_]*(?=\s|$)|[。！？।॥｡]+[\"'”」)）\]*]*|\s[/|–—-]+\s|[\r\n]+|[;；]|(?<=\p{Han}[^\p{L}]{0,3})(?=\p{Latin}+(?:['’\s-]+\p{Latin}+){2})|(?<=\p{Latin}[^\p{L}]{0,3})(?=\p{Han}{5})")
_WEAK = regex.compile(r"[,:，：]+(?=\s|\p{Han}|\p{Latin})")


def label_code(label: str | None) -> str | None:
    """Language that a label names, or None if it names none."""
    if not label:
        return None
    x = regex.sub(r"[^\p{L}\-_]", "", label.strip().lower())
    return _NAMED.get(x) or _NAMED.get(regex.split(r"[-_]", x)[0])


def label_column(label: Column) -> Column:
    """label_code as a Column."""
    x = F.regexp_replace(F.lower(label), r"[^\p{L}\-_]", "")
    names = F.create_map(*[F.lit(v) for kv in _NAMED.items() for v in kv])
    return F.coalesce(F.try_element_at(names, x), F.try_element_at(names, F.regexp_extract(x, r"^\p{L}+", 0)))


def _hash(s: str) -> int:
    """FNV-1a: the same in every process."""
    h = 2166136261
    for b in s.encode("utf-8", "replace"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 16) % BUCKETS


def word_features(w: str) -> list[int]:
    """Buckets of a lower-case word: itself, and its n-grams of 1 to 4 characters with word ends."""
    grams: set[str] = set()
    for v in {w, fold(w)}:  # also without accents
        x = f"^{v}$"
        grams |= {x} | {x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1)} | {"." + c for c in v}
    return sorted(_hash(g) for g in grams)


class Machines:
    """Fitted one-versus-one machines; plain arrays, so that they can be broadcast."""

    def __init__(self, pairs: list[tuple[tuple[str, ...], tuple[str, ...]]], weights: np.ndarray, bias: np.ndarray, scale: np.ndarray):
        self.pairs, self.weights, self.bias, self.scale = pairs, weights, bias, scale


def _fit_one(feat: np.ndarray, of_word: np.ndarray, row: np.ndarray, word: np.ndarray, n_words: int, y: np.ndarray, weight: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by accelerated gradient steps over all rows; the same result every time."""
    n = len(y)
    per = np.bincount(row, minlength=n).clip(1)
    size = np.bincount(of_word, minlength=n_words).clip(1)

    def margins(w: np.ndarray, b: float) -> np.ndarray:
        s = np.bincount(of_word, w[feat], n_words) / np.sqrt(size)
        return np.bincount(row, s[word], n) / per + b

    w, b = np.zeros(BUCKETS), 0.0
    acc, acc_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        g = -2 * weight * y * np.maximum(0, 1 - y * margins(w, b))
        gw = np.bincount(feat, (np.bincount(word, (g / per)[row], n_words) / np.sqrt(size))[of_word], BUCKETS) + 1e-5 * w
        acc += gw * gw
        acc_b += g.sum() ** 2
        w -= 0.3 * gw / np.sqrt(acc)
        b -= 0.3 * g.sum() / np.sqrt(acc_b)
    return w, b


def fit(texts: list[str], labels: list[str], families: dict[str, tuple[str, ...]] | None = None, epochs: int = 40) -> Machines:
    """Fits the machines on Latin texts; rows that the first fit strongly contradicts are dropped for the second."""
    families = families or FAMILIES
    names = list(families)
    pairs = [(families[a], families[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    for langs in families.values():
        pairs += [((a,), (b,)) for i, a in enumerate(langs) for b in langs[i + 1 :]]
    ids: dict[str, int] = {}
    rows, wordno = [], []
    for k, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            rows.append(k)
            wordno.append(ids.setdefault(w, len(ids)))
    feats = [word_features(w) for w in ids]
    of_word = np.repeat(np.arange(len(ids)), [len(f) for f in feats]) if feats else np.zeros(0, np.int64)
    feat = np.array([x for f in feats for x in f], np.int64)
    row, word, lab = np.array(rows, np.int64), np.array(wordno, np.int64), np.array(labels)
    weights, bias, scale = np.zeros((BUCKETS, len(pairs)), np.float32), np.zeros(len(pairs)), np.ones(len(pairs))
    for p, (a, b) in enumerate(pairs):
        y = np.where(np.isin(lab, a), 1.0, np.where(np.isin(lab, b), -1.0, 0.0))
        for last in (False, True):
            n_pos, n_neg = max(1, (y > 0).sum()), max(1, (y < 0).sum())
            wt = np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg) * (y != 0)
            w, c = _fit_one(feat, of_word, row, word, len(ids), y, wt, epochs)
            s = np.bincount(of_word, w[feat], len(ids)) / np.sqrt(np.bincount(of_word, minlength=len(ids)).clip(1))
            m = np.bincount(row, s[word], len(y)) / np.bincount(row, minlength=len(y)).clip(1) + c
            if not last:
                y = np.where(y * m < -0.3, 0.0, y)
        weights[:, p], bias[p] = w, c
        scale[p] = 3.0 / max(0.1, float(np.median(np.abs(m[y != 0])) if (y != 0).any() else 1.0))
    return Machines(pairs, weights, bias, scale)


def script(text: str) -> tuple[str, int, float, bool]:
    """Language of the script other than Latin that a text has most of: its units (words, or letters where words aren't parted), confidence, and whether units are words."""
    han = len(_HAN.findall(text))
    best = ("zh", han, min(0.999, 0.9 + han / 100), False)
    if not _OTHER.search(text):
        return best
    for lang, unit in _UNITS.items():
        n = len(unit.findall(text)) + (han if lang == "ja" else 0) * bool(lang == "ja" and unit.search(text))
        if lang != "zh" and n and n >= best[1]:
            _, spaced, sure = SCRIPTS[lang]
            best = (lang, n, min(0.999, sure + n / 100), spaced)
    n = len(_UNLISTED.findall(text))
    return best if n <= best[1] else (UNKNOWN, n, 0.5, True)


class Classifier:
    """Scores parts of texts with the machines, keeping the scores of words it has seen."""

    def __init__(self, m: Machines, families: dict[str, tuple[str, ...]] | None = None):
        self.m = m
        self.families = families or FAMILIES
        self.langs = [x for f in self.families.values() for x in f]
        self.words: dict[str, tuple[float, ...]] = {}
        self.texts: dict[str, list[tuple[str, float, int, int]]] = {}
        self.family_of = {x: f for f in self.families.values() for x in f}

    def word(self, w: str) -> tuple[float, ...]:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > KEEP:
                self.words.clear()
            f = word_features(w)
            got = self.words[w] = tuple((self.m.weights[f].sum(axis=0) / np.sqrt(len(f))).tolist())
        return got

    def margins(self, words: list[str]) -> list[float]:
        """Signed margins of every machine for a list of lower-case words, scaled."""
        n = max(1, len(words))
        sums = [sum(x) for x in zip(*map(self.word, words))] if words else [0.0] * len(self.m.pairs)
        return [(s / n + b) * k for s, b, k in zip(sums, self.m.bias, self.m.scale)]

    def latin(self, words: list[str]) -> tuple[str, float]:
        """Family first, then the language within it; confidence is the product of both."""
        got = self.margins(words)
        votes: dict[tuple[str, ...], float] = {}
        for (a, b), m in zip(self.m.pairs, got):
            if a in self.family_of.values() and len(a) + len(b) > 2:
                votes[a], votes[b] = votes.get(a, 0.0) + m, votes.get(b, 0.0) - m
        family = max(votes, key=votes.get)
        inside: dict[str, float] = dict.fromkeys(family, 0.0)
        for (a, b), m in zip(self.m.pairs, got):
            if len(a) == len(b) == 1 and a[0] in inside and b[0] in inside:
                inside[a[0]] += m
                inside[b[0]] -= m
        lang = max(inside, key=inside.get)
        conf = 1 / (1 + np.exp(-min(30.0, votes[family]))) / (1 + np.exp(-min(30.0, inside[lang])))
        return lang, float(conf)

    def fit_of(self, words: list[str], lang: str) -> float:
        """Least margin by which the machines prefer lang for the words; negative if one prefers another."""
        worst = 99.0
        for (a, b), m in zip(self.m.pairs, self.margins(words)):
            if lang in a:
                worst = min(worst, m)
            elif lang in b:
                worst = min(worst, -m)
        return worst

    def segments(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(lang, confidence, start, end) of each stretch of one language, in order."""
        if not text:
            return []
        key = _DIGITS.sub(lambda m: "0" * len(m.group()), text)
        got = self.texts.get(key)
        if got is None:
            if len(self.texts) > KEEP:
                self.texts.clear()
            got = self.texts[key] = self._segments(key)
        return got

    def _parts(self, text: str) -> list[tuple[int, int, bool]]:
        """Start, end and whether a strong end precedes, of the parts between ends."""
        bare = _BRACKETS.sub(lambda m: " " * len(m.group()) if len(_WORD.findall(m.group())) <= 4 and len(_HAN.findall(m.group())) <= 8 and m.start() else m.group(), text)
        cuts = sorted({(m.end(), True) for m in _STRONG.finditer(bare)} | {(m.end(), False) for m in _WEAK.finditer(bare)}, key=lambda x: (x[0], not x[1]))
        out, at, strong = [], 0, True
        for c, s in cuts:
            if c > at:
                out.append((at, c, strong))
                at, strong = c, s
            else:
                strong = strong or s
        if at < len(text):
            out.append((at, len(text), strong))
        self._bare = bare
        return out

    def _told(self, text: str, words: list[str] | None = None) -> tuple[str, float, int, int]:
        """Language and confidence of a text in lower case, its units, and the units it needs to count by itself."""
        words = _WORD.findall(text) if words is None else words
        lang, n, conf, spaced = script(text)
        if n and (n if spaced else 2 * n) >= len(words):
            return lang, conf, n, LEAST_WORDS if spaced else LEAST_HAN
        if not words:
            return UNKNOWN, 0.0, 0, LEAST_WORDS
        lang, conf = self.latin(words)
        return lang, conf, len(words), LEAST_WORDS

    def _segments(self, text: str) -> list[tuple[str, float, int, int]]:
        return [(UNKNOWN if s[1] < UNSURE and s[0] in self.langs else s[0], *s[1:]) for s in self._stretches(text)]

    def _stretches(self, text: str) -> list[tuple[str, float, int, int]]:
        parts = []
        total = []
        for a, b, strong in self._parts(text):
            piece = self._bare[a:b].lower()
            words = _WORD.findall(piece)
            lang, conf, n, needed = self._told(piece, words)
            if not n:
                continue
            total += words
            if lang in self.langs:
                n = len(words) - sum(w in POLITE for w in words)  # courtesies tell nothing
                needed += not strong
            parts.append([lang, conf, a, b, strong, n >= needed, n])
        if not parts:
            # only bracketed words: the brackets are the text
            lang, conf, n, _ = self._told(text.lower())
            return [(lang, conf, 0, len(text))] if n else []
        # parts between weak ends first join to clauses, unless both sides are long and surely differ
        clauses: list[list] = []
        for p in parts:
            if clauses and not p[4]:
                c = clauses[-1]
                sure = p[5] and c[5] and p[0] != c[0] and p[1] > 0.9 and c[1] > 0.9
                if not sure:
                    if p[6] > c[6]:
                        c[0], c[1] = p[0], p[1]
                    c[3], c[6] = p[3], c[6] + p[6]
                    if c[0] in self.langs and len(words := _WORD.findall(self._bare[c[2] : c[3]].lower())):
                        c[0], c[1] = self.latin(words)
                    c[5] = c[6] >= (LEAST_HAN if c[0] in SCRIPTS and not SCRIPTS[c[0]][1] else LEAST_WORDS)
                    continue
            clauses.append(p)
        strong_ones = [c for c in clauses if c[5]]
        if not strong_ones:
            # every part is short, as where each word has a line of its own: they are one text
            lang, conf, _, _ = self._told(self._bare.lower(), total)
            return [(lang, conf, clauses[0][2], clauses[-1][3])]
        # greetings, single terms and doubtful parts go with their neighbour
        out: list[list] = []
        for k, c in enumerate(clauses):
            if not c[5] or c[1] < DOUBT and len(clauses) > 1:
                near = out[-1][0] if out else next((d[0] for d in clauses[k:] if d[5] and d[1] >= DOUBT), strong_ones[0][0])
                c = [near, c[1] if near == c[0] else 0.5, *c[2:]]
                c[6] = 0
            if out and out[-1][0] == c[0]:
                if c[6] > out[-1][4]:
                    out[-1][1], out[-1][4] = c[1], c[6]
                out[-1][3] = c[3]
            else:
                out.append([c[0], c[1], c[2], c[3], c[6]])
        return [(o[0], float(o[1]), o[2], o[3]) for o in out]


def train(records: DataFrame, text_columns: list[str], label: str, sample_rows: int = SAMPLE_ROWS) -> Machines:
    """Fits the machines on at most sample_rows labelled texts of one clause, drawn evenly over the whole table."""
    h = F.xxhash64(*text_columns, label)
    share = min(1.0, 1.3 * sample_rows / max(1, records.count() * len(text_columns)))
    texts = F.explode(F.array(*[F.col(c) for c in text_columns])).alias("t")
    langs = [x for f in FAMILIES.values() for x in f]
    got = records.filter(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)) if share < 1 else F.lit(True)).select(label_column(F.col(label)).alias("lang"), h.alias("h"), texts)
    got = got.filter(F.col("lang").isin(langs) & F.col("t").rlike(r"\p{IsLatin}{2}") & ~F.col("t").rlike(r"\p{IsHan}|[.!?/|]\s+\p{L}|[\r\n]\s*\p{L}| - "))
    got = got.orderBy("h", "t").limit(sample_rows).toPandas()
    return fit(*with_common([regex.sub(_BRACKETS, " ", t) for t in got["t"]], list(got["lang"])))


def with_common(texts: list[str], labels: list[str], times: int = 5) -> tuple[list[str], list[str]]:
    """Adds the common words, each a few times, so that clauses unlike the sample are told as well."""
    more = [(w, lang) for lang, words in COMMON.items() for w in words.split()] * times
    return texts + [w for w, _ in more], labels + [lang for _, lang in more]


_READY: dict[str, Classifier] = {}


def classifier(shared: Shared) -> Classifier:
    """One classifier, with its known words and texts, for each worker process."""
    if shared.name not in _READY:
        _READY.clear()
        _READY[shared.name] = Classifier(shared.value)
    return _READY[shared.name]


def segments(records: DataFrame, machines: Machines | None = None) -> DataFrame:
    """(rec_id, seg_no, lang, confidence, start_pos, end_pos): every stretch of one language of every question."""
    shared = Shared(records.sparkSession, machines or train(records, ["question", "answer"], "q_lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = classifier(shared)
        for b in batches:
            rows = [(r, k, *s) for r, q in zip(b["rec_id"], b["question"]) for k, s in enumerate(c.segments(q), 1)]
            yield pd.DataFrame(rows, columns=["rec_id", "seg_no", "lang", "confidence", "start_pos", "end_pos"])

    return records.select("rec_id", "question").mapInPandas(run, "rec_id bigint, seg_no int, lang string, confidence double, start_pos int, end_pos int")


def found(records: DataFrame, machines: Machines | None = None) -> DataFrame:
    """(rec_id, seg_no, lang) of every record with a missing or wrong label or with several languages."""
    shared = Shared(records.sparkSession, machines or train(records, ["question", "answer"], "q_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = classifier(shared)
        codes: dict[str | None, str | None] = {}
        for b in batches:
            rec, no, lang = [], [], []
            for r, q, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = c.segments(q)
                if not got:
                    continue
                if len(got) == 1:
                    if label not in codes:
                        codes[label] = label_code(label)
                    if codes[label] == got[0][0]:
                        continue
                for k, s in enumerate(got, 1):
                    rec.append(r)
                    no.append(k)
                    lang.append(s[0])
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(no, pa.int32()), pa.array(lang, pa.string())], names=["rec_id", "seg_no", "lang"])

    return records.select("rec_id", "question", "q_lang").mapInArrow(run, "rec_id bigint, seg_no int, lang string")
