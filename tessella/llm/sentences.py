"""Sentence boundaries across languages and scripts.

A pushdown automaton reads the marks of each paragraph: a first pass pairs
quotes and brackets on a stack, so that unclosed ones open nothing; a second
pass walks the marks, and only at stack depth zero, or where an outermost pair
closes behind an inner terminator, may a unit end. A second stack holds the open
list levels of the text, by indentation, kind of marker and last number: a line
that continues a level, or opens one below its heading or parent, begins a unit.
Dots are looked up in a trie of abbreviations read backwards from the dot. All
passes are linear in the text.

Positions count code points from 0, end exclusive. Every character outside the
units is white space.

Defined cases: null, empty and blank texts have no units; a blank line always
ends a unit; a single line break never does by itself, except before the next
item of a list and between Thai phrases, where any white space does; marks that follow a unit with no letter or
digit of their own belong to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, marks and verbs of speech.
#: Never the last word of a sentence.
INNER = """
dr dra drs prof mr mrs ms mme mlle m sr sra srta st ste hr fr dipl ing rev gen col lt sgt capt hon
fig figs tab tabs sec secs eq eqs ref refs abb kap bd nr núm num vol ch chap pp pg art cap
vs e.g eg i.e ie cf approx viz resp incl excl bzw ca vgl usf sog ggf evtl zzgl aprox env ex ej p.ej p.ex
z.b d.h u.a s.o s.u i.d.r o.ä v.a डॉ श्री श्रीमती
""".split()
#: May end a sentence; it does where a capital follows.
OUTER = "etc al a.m p.m u.s u.k e.u usw jr inc ltd co corp dept est jan feb mar apr jun jul aug sep sept oct nov dec".split()
#: Abbreviations only before a number.
NUMBERED = "no nos p s art col".split()
#: German words after which a number with a dot is an ordinal.
ORDINAL = "der dem den des die das am im vom zum zur beim ab seit bis nach jeder jede jedem".split()
SPEECH = regex.compile(
    r"\b(?:said|says|asked|asks|noted|wrote|replied|added|answered|called|shouted|whispered|fragte|sagte|schrieb|antwortete|rief|meinte|demanda|dit|répondit|ajouta|demande|preguntó|dijo|respondió|añadió|pregunta)\b"
    r"|[说說问問道答喊叫]|(?:पूछा|कहा|बोला|बोली|बताया|लिखा)"
)
TERMINAL = ".!?…。！？।॥؟｡"
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "［": "］"}
CLOSERS = {")", "]", "}", "）", "】", "》", "〉", "」", "』", "»", "”", "“", "］"}
QUOTES = set("「『«“„\"")
#: Openers that each closer closes.
CLOSED_BY = {c: [o for o, x in OPENERS.items() if x == c] + ["„"] * (c == "”") for c in CLOSERS}

BLANK = regex.compile(r"(?:\r\n|[\n\r\x85\u2028\u2029])[^\S\n\r\x85\u2028\u2029]*(?:\r\n|[\n\r\x85\u2028\u2029])\s*")
MARKS = regex.compile(r"[.…]+|[!?。！？।॥؟｡]|[()\[\]{}（）【】《》〈〉「」『』«»“”„\"［］]|(?<=[฀-๿])\s+(?=[฀-๏])")
DASH = "-–—―"
CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}\p{Hangul}]")
WORD = regex.compile(r"\w")
NEXT_WORD = regex.compile(r"\w+")
PRECEDING = regex.compile(r"(\w+)\s+$")


#: A list marker at the beginning of a line: indentation, then a number, a small letter, a bullet or an ideographic number.
ITEM = regex.compile(r"([^\S\n\r\x85\u2028\u2029]*)(?:(\d{1,4})([.)）、])|[(（](\d{1,4})([)）])|([a-z])(\))|([*•‣◦·–-])|([一二三四五六七八九十])([、]))(?=\s|(?<=[、）])\S)")

LINE_END = regex.compile(r"[\n\r\x85\u2028\u2029]+")


class _Levels:
    """The pushdown store of list levels: indentation, kind of marker, last number."""

    def __init__(self):
        self.stack: list[list] = []

    def item(self, m: regex.Match, led: bool) -> bool:
        """Whether a marker continues an open level or, where led, opens one; levels deeper than it are closed."""
        indent = len(m.group(1).expandtabs(4))
        digits, letter, han = m.group(2) or m.group(4), m.group(6), m.group(9)
        kind = m.group(3) and "9" + m.group(3) or m.group(5) and "(9" + m.group(5) or letter and "a)" or han and "一" or m.group(8)
        number = int(digits) if digits else ord(letter) - 96 if letter else "一二三四五六七八九十".index(han) + 1 if han else 0
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        top = self.stack[-1] if self.stack else None
        if top and top[0] == indent and top[1] == kind and number in (0, top[2] + 1):
            top[2] = number
            return True
        if number <= 1 and (led or top and top[0] < indent):
            if top and top[0] == indent:
                self.stack.pop()
            self.stack.append([indent, kind, number])
            return True
        return False


def _trie(words: list[str], kind: str, into: dict) -> dict:
    for w in words:
        at = into
        for ch in reversed(w):
            at = at.setdefault(ch, {})
        at[""] = kind
    return into


_ABBREVIATIONS = _trie(INNER, "inner", _trie(OUTER, "outer", _trie(NUMBERED, "numbered", {})))


def _abbreviation(text: str, dot: int, start: int) -> str:
    """Kind of the longest abbreviation that ends at the dot and begins a word, read backwards through the trie."""
    at, i, kind = _ABBREVIATIONS, dot - 1, ""
    while i >= start:
        ch = text[i]
        if ch not in at:
            low = ch.lower()
            if low not in at:
                break
            ch = low
        at = at[ch]
        i -= 1
        if "" in at and (i < start or not (text[i].isalnum() or text[i] == "." and i > start and text[i - 1].isalnum()) or CASELESS.match(text[i]) and not CASELESS.match(text[i + 1])):
            kind = at[""]
    return kind


class _Paragraph:
    def __init__(self, text: str, start: int, end: int, levels: _Levels | None = None):
        self.text, self.start, self.end, self.levels = text, start, end, levels or _Levels()

    def ahead(self, i: int) -> tuple[int, str]:
        """Position and value of the next character that is no white space; end and '' if there is none."""
        text, end = self.text, self.end
        while i < end and text[i].isspace():
            i += 1
        return (i, text[i]) if i < end else (end, "")

    def pairs(self, marks: list) -> dict[int, int]:
        """Closing position of every opening mark that is closed in this paragraph; the pushdown store.

        Open marks are counted by kind, so the store is searched only for what it holds, and what is searched is popped.
        """
        text, stack, got = self.text, [], {}
        open_of: dict[str, int] = {}
        quote = -1  # place of the open straight quote in the store; there is one at most

        def pop() -> tuple[str, int]:
            ch, i = stack.pop()
            if ch:
                open_of[ch] -= 1
            return ch, i

        for m in marks:
            i = m.start()
            ch = text[i]
            if ch == '"':
                before = text[i - 1] if i > self.start else " "
                after = text[i + 1] if i + 1 < self.end else " "
                opened = quote >= 0
                opens = not after.isspace() and (before.isspace() or before in "([{（—–:：，,、" or before in TERMINAL and not opened)
                closes = not before.isspace() and (after.isspace() or not after.isalnum())
                if opened and not (opens and not closes):
                    got[stack[quote][1]] = i
                    while len(stack) > quote:
                        pop()
                    quote = -1
                elif opens or not opened:
                    if opened:
                        stack[quote] = ("", -1)
                    quote = len(stack)
                    stack.append(('"', i))
                    open_of['"'] = 1
                continue
            kinds = CLOSED_BY.get(ch, ())
            if any(open_of.get(o) for o in kinds):
                while True:
                    o, at = pop()
                    if o == '"':
                        quote = -1
                    if o in kinds:
                        break
                got[at] = i
            elif ch in OPENERS:
                stack.append((ch, i))
                open_of[ch] = open_of.get(ch, 0) + 1
        return got

    def items(self) -> list[tuple[int, int]]:
        """Beginning and end of each marker that begins an item on a line after the first."""
        text = self.text
        out = []
        for i in [self.start, *(m.end() for m in LINE_END.finditer(text, self.start, self.end))]:
            m = ITEM.match(text, i, self.end)
            if m is None:
                continue
            first = i == self.start
            before = i - 1
            while not first and before >= self.start and text[before].isspace():
                before -= 1
            if self.levels.item(m, first or text[before] in ":：") and not first:
                out.append((m.end(1), m.end()))
        return out

    def units(self) -> Iterator[tuple[int, int]]:
        text, end = self.text, self.end
        items = self.items()
        items.reverse()
        marks = list(MARKS.finditer(text, self.start, end))
        pairs = self.pairs([m for m in marks if text[m.start()] in OPENERS or text[m.start()] in CLOSERS or text[m.start()] == '"']) if marks else {}
        begin, skip = self.start, -1
        for m in marks:
            i, j = m.span()
            marker = False
            while items and items[-1][0] <= i:
                at, behind = items.pop()
                if at < skip or at <= begin:
                    marker = marker or at == begin and i < behind
                    continue
                yield begin, at
                begin, marker = at, i < behind
                skip = max(skip, behind)
            if marker or i < skip or i < begin:
                continue
            ch = text[i]
            if ch in TERMINAL:
                stop = self.after_terminator(i, j, begin)
            elif i in pairs:
                skip = close = pairs[i]
                stop = self.after_pair(i, close, begin)
                skip += 1
            elif ch.isspace():
                stop = i
            else:
                continue
            if stop:
                yield begin, stop
                begin = self.ahead(stop)[0]
        for at, _ in reversed(items):
            if at >= skip and at > begin:
                yield begin, at
                begin = at
        if begin < end:
            yield begin, end

    def closing(self, j: int) -> int:
        """Skips marks that still belong to the sentence end at j."""
        text, end = self.text, self.end
        while j < end and (text[j] in TERMINAL or text[j] in ")]}）】」』”’»" or text[j] in "\"'*_" and (j + 1 == end or not text[j + 1].isalnum())):
            j += 1
        return j

    def after_terminator(self, i: int, j: int, begin: int) -> int:
        """End of the unit if one ends at the terminator text[i:j], else 0."""
        text, end = self.text, self.end
        mark = text[i]
        more = j < end and text[j] in TERMINAL
        if more:
            return 0  # the last of several marks decides
        if mark == "." and j == i + 1 and text[i - 1 : i] not in TERMINAL:
            if i == begin or j < end and text[j].isalnum() and not self.glued(i, j):
                return 0
            if self.abbreviated(i, j, begin):
                return 0
        stop = self.closing(j)
        at, nxt = self.ahead(stop)
        if not nxt:
            return stop
        spaced = at > stop
        dots = mark in ".…" and (j > i + 1 or text[i - 1 : i] in (".", "…") or mark == "…")
        if not spaced:
            if nxt in ",;:，；：、" or nxt in DASH or nxt in "/@=&%":
                return 0
            if dots:
                return stop if nxt.isupper() and self.glued(j - 1, j) and j == stop else 0
            if nxt.islower() or nxt.isdigit() and mark in ".!?":
                return 0
            return stop
        if nxt in DASH:
            follow = self.ahead(at + 1)[1]
            if follow.islower():
                return 0
        if nxt in TERMINAL and mark not in TERMINAL:
            return 0
        if nxt.islower():
            word = NEXT_WORD.match(text, at, end)
            mixed = word is not None and not word.group().islower()
            if mark in ".…" and not mixed:
                return 0
        return stop

    def glued(self, i: int, j: int) -> bool:
        """A sentence end with no space after it: a lower-case word, the mark, a capitalised word."""
        text = self.text
        if j >= self.end:
            return False
        if CASELESS.match(text[j]):
            return not text[i - 1 : i].isdigit()
        before = text[i - 1 : i]
        if before in TERMINAL and before:
            before = text[i - 3 : i - 2] or text[i - 2 : i - 1]
        ends = before.islower() or before in ")]\"”»" and before or before.isdigit()
        return bool(ends) and text[j].isupper() and (j + 1 >= self.end or not text[j + 1].isupper() or before.islower()) and (text[j + 1 : j + 2] != "." or text[i - 3 : i].isalpha())

    def abbreviated(self, i: int, j: int, begin: int) -> bool:
        """True if the single dot at i doesn't end a sentence because of the word before it."""
        text = self.text
        at, nxt = self.ahead(j)
        kind = _abbreviation(text, i, begin)
        if kind == "inner":
            return True
        if kind == "outer":
            return not (nxt.isupper() or not nxt or not nxt.isalnum() and nxt not in ",;:)") or at == j and not nxt.isupper()
        if kind == "numbered" and nxt.isdigit() and text[i - 2 : i - 1].islower() | (not text[i - 2 : i - 1].isalpha()):
            return True
        word = i - 1
        while word >= begin and text[word].isalnum():
            word -= 1
        token = text[word + 1 : i]
        if not token:
            return False
        if len(token) == 1 and token.isalpha() and not CASELESS.match(token):
            single = word < begin or not text[word].isalnum() and text[word] not in "'’"
            if single and (nxt.isalpha() or not nxt):
                return bool(nxt) and (token.isupper() and nxt.isupper() or token.islower() and at > j)
        if token.isdigit():
            if word < begin:
                return bool(nxt) and at > j and not text[begin:i].strip("0123456789")  # the number of a list item
            before = PRECEDING.search(text, max(begin, word - 20), word + 1)
            if before and before.group(1).lower() in ORDINAL and nxt.isupper() and at > j:
                return True
        return False

    def after_pair(self, i: int, close: int, begin: int) -> int:
        """End of the unit if one ends with the pair text[i:close+1], else 0."""
        text, end = self.text, self.end
        last = close - 1
        while last > i and text[last].isspace():
            last -= 1
        if text[last] not in TERMINAL:
            return 0
        if text[last] == "." and text[i] not in QUOTES and self.abbreviated(last, last + 1, i + 1):
            return 0
        stop = close + 1
        at, nxt = self.ahead(stop)
        if not nxt:
            return 0
        if nxt in ",;，；、:：" or nxt in TERMINAL or nxt in ")]}）】」』”»":
            return 0
        if nxt.islower():
            word = NEXT_WORD.match(text, at, end)
            mixed = word is not None and not word.group().islower()
            return stop if mixed and WORD.search(text, begin, i) else 0
        if nxt in DASH:
            return 0 if self.ahead(at + 1)[1].islower() else stop
        introduced = WORD.search(text, begin, i) is not None
        if text[i] not in QUOTES:
            return stop if not introduced or at > stop and nxt.isupper() else 0
        if text[at : at + 1] in "とっ" and at == stop:
            return 0
        if introduced or not nxt.isalpha():
            return stop
        clause = regex.compile(r"[^.!?。！？।…\"“「«\n]{0,60}").match(text, at, end).group()
        if CASELESS.match(nxt):
            return 0 if SPEECH.search(clause[:40]) else stop
        return 0 if SPEECH.search(" ".join(clause.split()[:6])) else stop


def boundaries(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit of one text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at, levels = 0, _Levels()
    for m in [*BLANK.finditer(text), None]:
        start, end = at, m.start() if m else len(text)
        at = m.end() if m else at
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start == end:
            continue
        first = len(out)
        for a, b in _Paragraph(text, start, end, levels).units():
            while b > a and text[b - 1].isspace():
                b -= 1
            if len(out) > first and WORD.search(text, a, b) is None:
                out[-1] = (out[-1][0], b)
            elif b > a:
                out.append((a, b))
    return out


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos): one row per sentence unit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [boundaries(t) for t in b.column(1).to_pylist()]
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.array([x for g in got for x in g], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(got)), n))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc_id", "start_pos", "end_pos"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start_pos bigint, end_pos bigint")


def sentence_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sentence): the sentences of every document in order, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [boundaries(t) for t in texts]
            n = np.fromiter(map(len, got), np.int64, len(got))
            no = [k + 1 for g in got for k in range(len(g))]
            out = [t[a:e] for t, g in zip(texts, got) for a, e in g]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(got)), n))), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=["doc_id", "sent_no", "sentence"])

    return documents.select("doc_id", F.col("text")).mapInArrow(run, "doc_id bigint, sent_no int, sentence string")
