"""Courtesies around questions, and texts without them."""

from __future__ import annotations

import unicodedata

import regex

# Courtesies in the languages of the questions.
COURTESIES = [
    "please tell me", "please answer", "quick question", "ok so", "please", "thank you", "thanks", "hello", "hi", "doctor", "briefly", "in brief", "kindly", "could you tell me", "can you tell me",
    "bitte sagen", "kurze frage", "bitte kurz", "bitte antworten", "bitte", "danke", "hallo", "guten tag", "herr doktor", "also", "kurz",
    "dites moi", "petite question", "s il vous plaît", "s il vous plait", "merci", "bonjour", "docteur", "brièvement", "brievement", "alors",
    "por lo general", "en general", "por favor", "una pregunta", "brevemente", "dígame", "digame", "gracias", "hola", "doctora", "bueno",
    "想问一下", "请问", "请回答", "您好", "你好", "谢谢", "医生", "请简要回答", "请简单回答", "简要回答", "麻烦", "那么", "请",
]

#: The words of the courtesies, also where they are misspelled.
POLITE = {w for x in COURTESIES for w in x.split() if x.isascii() and w not in {"you", "can", "could", "en", "lo", "una", "also"}}
_BRACKETS = regex.compile(r"[(（\[][^()（）\[\]]{0,40}[)）\]]")
_NUMBER = regex.compile(r"\p{N}")
_GAPS, _MARKS, _HAN_GAPS = regex.compile(r"[_\s]+").sub, regex.compile(r"[\p{P}\p{S}]+").sub, regex.compile(r"(?<=\p{Han})\s+(?=\p{Han})").sub
_COURTESY = regex.compile("|".join(rf"(?<![\p{{L}}]){regex.escape(x)}(?![\p{{L}}])" if x.isascii() or not regex.search(r"\p{Han}", x) else regex.escape(x) for x in sorted(COURTESIES, key=len, reverse=True)))


def fold(w: str) -> str:
    """Without accents, so that a missing one is no difference."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def plain(question: str) -> str:
    """Lower case with single spaces, without brackets of words, courtesies and marks."""
    x = _GAPS(" ", question.lower())
    bare = _BRACKETS.sub(lambda m: m.group() if _NUMBER.search(m.group()) else " ", x)
    x = bare if 2 * len(bare) > len(x) else x  # a text that is all in brackets stays
    x = _HAN_GAPS("", _GAPS(" ", _MARKS(" ", x)))
    return _COURTESY.sub(" ", x)
