"""Mapping of free-typed values to the entries of a reference list.

BK-trees over the words and over the joined spellings of the reference entries,
under the unrestricted Damerau-Levenshtein distance, which is a true metric;
the triangle inequality prunes the search, and every key within the threshold
comes back. An entry fits a value if each of its words is written in it, in any
order, exact, misspelled or shortened, or if its joined spelling is; the best
cost wins. A value that names nothing, two entries, or several equally well is
unmatched (-1).

A reference list of up to BROADCAST_ENTRIES spellings is broadcast; a longer one
is dealt to shards and each value meets each shard. What a shard needs to know of
the others comes with the value or the shard: which of the value's words are
written in the list, which fillers and joiners are spellings, the longest key.
The shards' parts are merged before anything is decided, and a whole list is
merged as its only part, so both ways give the same entry.

Defined cases: null values and values without a letter or digit are no cases;
values that literally are a label need no mapping; an empty reference list
leaves every value unmatched.
"""

from __future__ import annotations

import pickle
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.cut import Scratch
from tessella.plans.spread import spread_join

#: Spellings that are broadcast, spellings of a shard beyond that, and values that meet a shard in one task.
BROADCAST_ENTRIES, SHARD_ENTRIES, SLICE_VALUES = 200_000, 20_000, 50_000
UNMATCHED = -1
#: Costs beside edits: a word shortened to three letters or more, to two, and a word left out.
SHORTENED, CLIPPED, MISSING = 0.5, 0.9, 3.0
#: Added where less than half of an entry's letters, or fewer than five, are written; such a candidate only makes others ambiguous.
WEAK = 50.0
#: Keys below a node of a tree from which its exact distance is worth working out.
FEW_BELOW = 64
# Words that may stand around a value, joiners of two values, and short forms of words of side.
FILLERS = set("a an the is it its this that these shows show showing probably likely most maybe perhaps possibly possible i think see arrow area region of in on at to be seems looks like appears suspected here there would say".split())
JOINERS = set("and or plus und oder et ou y o vs versus both either & +".split())
JOINED_BEFORE = ["mostlikelythe", "mostlikely", "probablythe", "probably", "ithinkitisthe", "ithinkitis", "ithinkthe", "ithink", "itisthe", "itis", "thisshowsthe", "thisshows", "this", "possibly", "maybe", "the"]
JOINED_AFTER = ["seearrow", "area", "region"]
SIDES = {"l": "left", "lt": "left", "lft": "left", "r": "right", "rt": "right", "rgt": "right", "up": "upper", "upr": "upper", "u": "upper", "low": "lower", "lwr": "lower", "lo": "lower"}

_HAN = regex.compile(r"\p{Han}")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: A capital after at least two small letters begins a word that was written together with the last one.
_CAMEL = regex.compile(r"(?<=\p{Ll}\p{Ll})(?=\p{Lu}\p{Ll})")


def distance(a: str, b: str, most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and transpositions; if it is over most, some number over most."""
    if a == b:
        return 0
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    n = min(len(a), len(b))
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    if i:
        a, b = a[:-i], b[:-i]
    la, lb = len(a), len(b)
    if not la or not lb:
        return la + lb
    if la == 1 or lb == 1:
        return max(la, lb) - (1 if la == 1 and a in b or lb == 1 and b in a else 0)
    far = la + lb
    if most is None or most > far:
        most = far
    if abs(la - lb) > most:
        return most + 1
    last: dict[str, int] = {}
    rows = [[far] * (lb + 2), [far, *range(lb + 1)]]
    for x in range(1, la + 1):
        # cells further than most from the diagonal can't be on a path that counts
        lo, hi = max(1, x - most), min(lb, x + most)
        ca, prev, match = a[x - 1], rows[x], 0
        row = [far, x] + [far] * (lo - 1)
        least = x if lo == 1 else far
        if lo > 1:
            match = b.rfind(ca, 0, lo - 1) + 1
        for y in range(lo, hi + 1):
            cb = b[y - 1]
            if ca == cb:
                best, seen = prev[y], y
            else:
                best, seen = prev[y], match
                if row[y] < best:
                    best = row[y]
                if prev[y + 1] < best:
                    best = prev[y + 1]
                best += 1
            if match and (k := last.get(cb, 0)):
                t = rows[k][match] + (x - k) + (y - match - 1)
                if t < best:
                    best = t
            row.append(best)
            if best < least:
                least = best
            match = seen
        if hi < lb:
            row += [far] * (lb - hi)
        if least > most:
            return most + 1  # every path crosses the row, or deletes its way to it at less than it costs to jump over it
        last[ca] = x
        rows.append(row)
    return rows[la + 1][lb + 1]


def threshold(n: int) -> int:
    """Edits allowed in a key of n characters."""
    return 0 if n <= 3 else 1 if n <= 5 else n // 3


class BkTree:
    """Keys under ``distance``; a node is [key, children by distance, letters, furthest child, keys below it]."""

    def __init__(self, keys: Iterator[str] | list[str]):
        self.root: list | None = None
        self.bits: dict[tuple[str, int], int] = {}
        for k in dict.fromkeys(keys):
            self.add(k)

    def letters(self, key: str, learn: bool = False) -> tuple[int, int]:
        """A bit for each letter and repetition of it that the tree knows, and how many it doesn't know."""
        seen: dict[str, int] = {}
        got = unknown = 0
        for c in key:
            n = seen[c] = seen.get(c, 0) + 1
            bit = self.bits.get((c, n))
            if bit is None:
                if not learn:
                    unknown += 1
                    continue
                bit = self.bits[c, n] = len(self.bits)
            got |= 1 << bit
        return got, unknown

    def add(self, key: str) -> None:
        new = [key, {}, self.letters(key, True)[0], -1, 0]
        if self.root is None:
            self.root = new
            return
        node = self.root
        while d := distance(key, node[0]):
            node[3] = max(node[3], d)
            node[4] += 1
            if d not in node[1]:
                node[1][d] = new
                return
            node = node[1][d]

    def within(self, key: str, k: int) -> list[tuple[str, int]]:
        """Every stored key at distance k or less.

        The letters that one side has more than the other bound a distance from
        below, the longer side bounds it from above. Beyond k and its furthest child
        a node and all below it are ruled out by the triangle inequality; where few
        keys are below, the bounds choose the children, else the exact distance.
        """
        out, todo = [], [self.root] if self.root else []
        mine, unknown = self.letters(key)
        while todo:
            at, below, letters, furthest, size = todo.pop()
            least = max((mine & ~letters).bit_count() + unknown, (letters & ~mine).bit_count())
            most = k + max(furthest, 0)
            if least > most:
                continue
            if least > k and size <= FEW_BELOW:
                d, top = least, max(len(key), len(at))
            else:
                if size <= FEW_BELOW:
                    d = distance(key, at, k)
                    top = d if d <= k else max(len(key), len(at))
                else:
                    d = top = distance(key, at, most)
                    if d > most:
                        continue
                if d <= k:
                    out.append((at, d))
            for e in range(max(1, d - k), min(furthest, top + k) + 1):
                if e in below:
                    todo.append(below[e])
        return out


def words(value: str) -> list[str]:
    return _WORDS.findall(_CAMEL.sub(" ", unicodedata.normalize("NFKC", value)).lower())


def _shortened_run(j: str, form: tuple[str, ...]) -> bool:
    """j is the entry's words in order, written in one, each whole, cut after three letters or more, or a short form of a side."""
    if not form:
        return not j
    w = form[0]
    ways = [w, *(w[:k] for k in range(len(w) - 1, 2, -1)), *(s for s, full in SIDES.items() if full == w)]
    return any(j.startswith(x) and _shortened_run(j[len(x) :], form[1:]) for x in ways)


def _forms(w: list[str]) -> list[tuple[str, ...]]:
    """The words of a spelling, and with a plural at the end."""
    forms = [tuple(w)]
    if len(w[-1]) > 3:
        forms.append((*w[:-1], w[-1] + ("es" if w[-1].endswith(("s", "x")) else "s")))
    return forms


def _keys(w: list[str]) -> list[str]:
    """A spelling in one word, also with leading words moved to the end."""
    return ["".join(w[k:] + w[:k]) for k in range(len(w))]


class Part(NamedTuple):
    """What one list of spellings, or one shard of it, holds for a value."""

    named: bool  # the value's words in one are a spelling
    han: list[tuple[str, list[int]]]  # Han spellings inside the value
    han_near: list[tuple[int, float]]  # Han spellings that the value may misspell
    first: dict[tuple[int, int], float]  # (canon_id, mask) to cost: by words, or exactly in one
    second: dict[tuple[int, int], float]  # by a joined spelling that is misspelled or shortened; counts if no first candidate is good
    n: int  # words that aren't fillers
    letters: int  # of the words in one


def _good(first: dict[tuple[int, int], float], n: int, letters: int) -> bool:
    """A candidate uses every word at little cost, so misspelled joined spellings aren't asked for."""
    return any(mask == (1 << n) - 1 and cost < 1 + letters / 8 for (_, mask), cost in first.items())


class Matcher:
    """Matches values against spellings (canon_id, text); kept, longest and several say what a shard can't know of the whole list."""

    def __init__(self, spellings: list[tuple[int, str]], kept: frozenset[str] | None = None, longest: int = 0, several: frozenset[str] = frozenset()):
        self.entries: list[tuple[int, tuple[str, ...]]] = []
        self.han: dict[str, list[int]] = {}
        self.joined: dict[str, set[int]] = {}
        self.several: set[str] = set()
        self.by_word: dict[str, list[int]] = {}
        self.begun: dict[str, list[int]] = {}  # entries of several words by how their first word may begin
        for cid, text in spellings:
            w = words(text)
            if not w:
                continue
            if _HAN.search(text):
                self.han.setdefault("".join(w), []).append(cid)
                continue
            for key in _keys(w):
                self.joined.setdefault(key, set()).add(cid)
                if len(w) > 1 or key in several:
                    self.several.add(key)
            for f in _forms(w):
                self.entries.append((cid, f))
                for x in set(f):
                    self.by_word.setdefault(x, []).append(len(self.entries) - 1)
                if len(f) > 1:
                    for x in {f[0][:3], *(x for x, full in SIDES.items() if full == f[0])}:
                        self.begun.setdefault(x, []).append(len(self.entries) - 1)
        self.kept = frozenset((FILLERS | JOINERS) & self.joined.keys()) if kept is None else kept
        self.word_tree, self.joined_tree, self.han_tree = BkTree(self.by_word), BkTree(self.joined), BkTree(x for x in self.han if len(x) >= 4)
        self.ordered = sorted(self.several)
        self.han_lengths = sorted({len(x) for x in self.han}, reverse=True)
        self.longest = max(longest, *map(len, [*self.by_word, *self.joined]), 0) + max(map(len, JOINED_BEFORE)) + max(map(len, JOINED_AFTER))
        self.prefixes: dict[str, list[str]] = {}
        for x in self.by_word:
            for k in range(2, len(x)):
                self.prefixes.setdefault(x[:k], []).append(x)
        self.near = lru_cache(200_000)(self._near)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "near"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.near = lru_cache(200_000)(self._near)

    def _near(self, token: str, known: bool) -> tuple[tuple[str, float], ...]:
        """(reference word, cost) that the token may write; a word known in another shard writes nothing else."""
        got: dict[str, float] = {}
        if token in self.by_word:
            return ((token, 0.0),)
        if known:
            return ()
        if len(token) > 2 * self.longest:
            return ()  # no edit threshold reaches that far
        most = max(threshold(len(token)), threshold(len(token) + 2)) if len(token) > 3 else 1 if len(token) == 3 else 0
        for w, d in self.word_tree.within(token, most):
            if d <= threshold(len(w)):
                got[w] = d + (0.4 if w[0] != token[0] else 0.0)
        for w in self.prefixes.get(token, ()):
            got[w] = min(got.get(w, 9.0), SHORTENED if len(token) > 2 else CLIPPED)
        if (w := SIDES.get(token)) in self.by_word:
            got[w] = min(got.get(w, 9.0), 0.2)
        return tuple(got.items())

    def part(self, value: str, known: frozenset[str] = frozenset()) -> Part:
        named = "".join(words(value)) in self.joined
        han, han_near = self._han(value) if _HAN.search(value) else ([], [])
        value = _latin(value)
        tokens = [t for t in words(value) if t not in FILLERS or t in self.kept]
        if not tokens:
            tokens = words(value)
        content = [t for t in tokens if t not in JOINERS or t in self.kept]
        out: dict[tuple[int, int], float] = {}
        near = [dict(self.near(t, t in known)) for t in content]
        for e in {e for n in near for w in n for e in self.by_word[w]}:
            cid, form = self.entries[e]
            got = self._align(form, near, content)
            if got:
                key = (cid, got[1])
                out[key] = min(out.get(key, 99.0), got[0])
        everything = (1 << len(content)) - 1
        joined = "".join(tokens)
        for j in dict.fromkeys([joined, self._bare(joined)]):
            for cid in self.joined.get(j, ()):
                out[cid, everything] = 0.0
        more: dict[tuple[int, int], float] = {}
        if joined and len(joined) <= 2 * self.longest and not _good(out, len(content), len(joined)):
            for j in dict.fromkeys([joined, self._bare(joined)]):
                for key, d in self.joined_tree.within(j, self._joined_threshold(j)):
                    if d <= (max(1, len(key) // 5) if key in self.several else threshold(len(key))):
                        cost = d + 0.01 + (0.4 if key[0] != j[0] else 0.0)
                        for cid in self.joined[key]:
                            more[cid, everything] = min(more.get((cid, everything), 99.0), cost)
                for e in {e for k in (1, 2, 3) for e in self.begun.get(j[:k], ())} if len(j) > 3 else ():
                    cid, form = self.entries[e]
                    if _shortened_run(j, form):
                        more[cid, everything] = min(more.get((cid, everything), 99.0), SHORTENED)
                if len(j) > 6:
                    for i in range(bisect_left(self.ordered, j), len(self.ordered)):
                        key = self.ordered[i]
                        if not key.startswith(j):
                            break
                        cost = MISSING + (0.0 if 5 * len(j) >= 3 * len(key) else WEAK)
                        for cid in self.joined[key]:
                            more[cid, everything] = min(more.get((cid, everything), 99.0), cost)
        return Part(named, han, han_near, out, more, len(content), len(joined))

    @staticmethod
    def _joined_threshold(j: str) -> int:
        n = len(j)
        return max(1, n // 4) if n > 3 else 0

    @staticmethod
    def _bare(joined: str) -> str:
        """Without fillers that were written in one word with the value."""
        again = True
        while again:
            again = False
            for x in JOINED_BEFORE:
                if joined.startswith(x) and len(joined) > len(x) + 1:
                    joined, again = joined[len(x) :], True
            for x in JOINED_AFTER:
                if joined.endswith(x) and len(joined) > len(x) + 1:
                    joined, again = joined[: -len(x)], True
        return joined

    @staticmethod
    def _align(form: tuple[str, ...], near: list[dict[str, float]], content: list[str]) -> tuple[float, int] | None:
        """Least cost of giving each word of the entry its own word of the value; a missing rest may cost up to half the letters."""
        best: tuple[float, int, int] | None = None
        todo = [(0, 0.0, 0, 0)]
        while todo:
            k, cost, mask, have = todo.pop()
            if k == len(form):
                if mask and (best is None or (-have, cost) < (-best[2], best[0])):
                    best = (cost, mask, have)
                continue
            w = form[k]
            for i, n in enumerate(near):
                if not mask >> i & 1 and w in n and (len(form) > 1 or n[w] != CLIPPED and (n[w] != SHORTENED or len(content[i]) > 4 and 2 * len(content[i]) >= len(w))):
                    todo.append((k + 1, cost + n[w], mask | 1 << i, have + min(len(w), len(content[i]))))
            if len(form) > 1:
                todo.append((k + 1, cost + MISSING, mask, have))
        if best is None:
            return None
        if best[0] >= MISSING and (2 * best[2] < sum(map(len, form)) or best[2] < 5):
            best = (best[0] + WEAK, best[1], best[2])
        # words of side and clipped ones alone name nothing
        strong = any(w in n and n[w] != CLIPPED and w not in SIDES.values() for w in form for n in near)
        return (best[0], best[1]) if strong else None

    def _han(self, value: str) -> tuple[list[tuple[str, list[int]]], list[tuple[int, float]]]:
        """Han spellings inside the value, and those it may misspell: by the tree, as other spellings."""
        text = "".join(words(value))
        # every stretch that is as long as some spelling is looked up
        inside = {text[i : i + n] for n in self.han_lengths for i in range(len(text) - n + 1) if text[i : i + n] in self.han}
        if inside:
            return [(key, self.han[key]) for key in sorted(inside)], []
        if len(text) > 2 * max(self.han_lengths, default=0):
            return [], []
        near = self.han_tree.within(text, max(threshold(len(text)), threshold(len(text) + 2)))
        return [], [(cid, float(d)) for key, d in near if d <= threshold(len(key)) for cid in self.han[key]]


def _latin(value: str) -> str:
    """The value without Han characters, if other words in Latin letters are around them; else it names nothing by words."""
    if not _HAN.search(value):
        return value
    return _HAN.sub(" ", value) if regex.search(r"\p{Latin}{2}", value) else ""


def han_candidates(value: str, parts: list[Part]) -> list[tuple[int, float, int, int]]:
    """The longest Han spellings inside the value, each taken out of it before a shorter one is looked for; else the misspelled ones."""
    out, rest, k = [], "".join(words(value)), 0
    inside: dict[str, list[int]] = {}
    for p in parts:
        for key, cids in p.han:
            inside.setdefault(key, []).extend(cids)
    for key in sorted(inside, key=lambda x: (-len(x), x)):
        if key in rest:
            out.extend((cid, 0.0, 1 << k, 1) for cid in sorted(set(inside[key])))
            rest = rest.replace(key, " ")
            k += 1
    return out or [(cid, cost, 1, 1) for p in parts for cid, cost in p.han_near]


def candidates(value: str, parts: list[Part]) -> list[tuple[int, float, int, int]]:
    """(canon_id, cost, mask of the value's words used, number of words that aren't fillers) of the parts of the whole list."""
    if got := han_candidates(value, parts):
        return got
    out: dict[tuple[int, int], float] = {}
    for p in parts:
        out.update(p.first)
    if not _good(out, parts[0].n, parts[0].letters):
        for p in parts:
            for key, cost in p.second.items():
                out[key] = min(out.get(key, 99.0), cost)
    return [(cid, cost, mask, parts[0].n) for (cid, mask), cost in out.items()]


def decide(candidates: list[tuple[int, float, int, int]]) -> int:
    """The one entry that fits best, or UNMATCHED; the same rule for one tree and for merged shards."""
    if not candidates:
        return UNMATCHED
    # complete entries first, then more of the value, then the least cost
    order = sorted(candidates, key=lambda c: (c[1] >= MISSING, -bin(c[2]).count("1"), c[1], c[0]))
    cid, cost, mask, n = order[0]
    if cost >= WEAK:
        return UNMATCHED
    for other, oc, om, _ in order[1:]:
        if other == cid:
            continue
        if cost >= MISSING and mask & om == mask or om == mask and oc <= cost + 1e-9:
            return UNMATCHED  # the words that are written fit another entry as well
        if oc < MISSING and (om & ~mask and not om & mask or bin(om).count("1") == bin(mask).count("1") and oc <= cost + 1e-9):
            return UNMATCHED  # a second entry beside the first
    return cid


def asked(value: str) -> list[str]:
    """The value and, if words stand on both sides of a joiner, the texts before and after it."""
    tokens = words(value)
    at = next((i for i, t in enumerate(tokens[:-1]) if i and t in JOINERS), None)
    return [value] if at is None else [value, " ".join(tokens[:at]), " ".join(tokens[at + 1 :])]


def conclude(value: str, parts: list[list[Part]], kept: frozenset[str]) -> int:
    """The entry of a value from the parts of each of its asked texts."""
    if len(parts) > 1 and not han_candidates(value, parts[0]) and not any(p.named for p in parts[0]):
        left, right = (decide(candidates(t, p)) for t, p in zip(asked(value)[1:], parts[1:]))
        return left if left == right else UNMATCHED
    got = candidates(value, parts[0])
    cid = decide(got)
    if cid == UNMATCHED or _HAN.search(value):
        return cid
    best = max((c for c in got if c[0] == cid), key=lambda c: (bin(c[2]).count("1"), -c[1], -c[2]))
    tokens = words(value)
    content = [t for t in tokens if t not in FILLERS or t in kept] or tokens
    left = [t for i, t in enumerate([t for t in content if t not in JOINERS or t in kept]) if not best[2] >> i & 1]
    # a word of side beside the entry names another one
    return UNMATCHED if any(t in ("left", "right", "upper", "lower") for t in left) else cid


class _Decider:
    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def __call__(self, value: str) -> int:
        return conclude(value, [[self.matcher.part(t)] for t in asked(value)], self.matcher.kept)


def spellings(reference: DataFrame) -> DataFrame:
    """(canon_id, text) of every label and alias of (canon_id, label, aliases)."""
    every = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return reference.select("canon_id", F.explode(every).alias("text")).filter("text is not null")


def match_values(values: DataFrame, reference: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, shards: int | None = None) -> DataFrame:
    """(value, canon_id) for distinct texts (value)."""
    spark = values.sparkSession
    texts = spellings(reference)
    entries = texts.count()
    if entries <= broadcast_entries:
        shared = spark.sparkContext.broadcast([(r["canon_id"], r["text"]) for r in texts.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one = _Decider(Matcher(shared.value))
            for b in batches:
                yield pd.DataFrame({"value": b["value"], "canon_id": [one(v) for v in b["value"]]})

        # few bytes, much work: spread over all cores, whatever the size
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return values.select("value").repartition(parts).mapInPandas(run, "value string, canon_id bigint")
    scratch = Scratch(spark, "spellings")
    listed = scratch.keep(texts.mapInPandas(_listed, "canon_id bigint, text string, words array<string>, keys array<string>"))
    known = listed.select(F.explode("words").alias("word")).distinct()
    several = listed.filter("size(keys) > 1").select(F.explode("keys").alias("key")).distinct()
    keys = listed.select(F.explode("keys").alias("key"))
    kept = frozenset(r["key"] for r in keys.filter(F.col("key").isin(sorted(FILLERS | JOINERS))).distinct().collect())
    longest = keys.unionAll(known.select("word")).agg(F.max(F.char_length("key"))).first()[0] or 0
    # a spelling of one word that other entries write in several
    listed = listed.join(several, F.when(F.size("keys") == 1, F.get("keys", F.lit(0))) == F.col("key"), "left").select("canon_id", "text", "key")
    written = values.select("value").mapInPandas(_written, "value string, word string").join(known, "word", "left_semi").groupBy("value").agg(F.collect_set("word").alias("known"))
    # every value meets every shard of the list; both sides of a meeting are bounded, and a shard's trees are built once
    shards = shards or max(1, -(-entries // SHARD_ENTRIES))
    slices = max(16, values.count() // SLICE_VALUES)

    def build(b: pd.DataFrame) -> pd.DataFrame:
        m = Matcher(list(zip(b["canon_id"], b["text"])), kept, longest, frozenset(b["key"].dropna()))
        return pd.DataFrame({"shard": [int(b["shard"].iloc[0])], "trees": [pickle.dumps(m)]})

    trees = scratch.keep(listed.withColumn("shard", F.pmod(F.xxhash64("canon_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, trees binary"))
    trees = trees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    every = values.select("value").join(written, "value", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(slices)).cast("int"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # a shard that holds no entry takes part with an empty list, so that a value's parts tell its words
        m = pickle.loads(b["trees"].iloc[0]) if len(b) else Matcher([], kept, longest)
        rows = []
        for v, k in zip(a["value"], a["known"]):
            k = frozenset(() if k is None else k)
            rows.append((v, pickle.dumps([tuple(m.part(t, k)) for t in asked(v)])))
        return pd.DataFrame(rows, columns=["value", "got"])

    def merge(value: pd.Series, got: pd.Series) -> pd.Series:
        return pd.Series([conclude(v, [[Part(*p) for p in text] for text in zip(*map(pickle.loads, g))], kept) for v, g in zip(value, got)], dtype="int64")

    met = every.groupBy("shard", "slice").cogroup(trees.groupBy("shard", "slice")).applyInPandas(meet, "value string, got binary")
    return met.groupBy("value").agg(F.collect_list("got").alias("got")).select("value", F.pandas_udf(merge, "bigint")("value", "got").alias("canon_id"))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spellings with the words and joined keys they add to the list; those in Han characters add none."""
    for b in batches:
        split = [[] if _HAN.search(t) else words(t) for t in b["text"]]
        yield b.assign(words=[sorted({x for f in _forms(w) for x in f}) if w else [] for w in split], keys=[_keys(w) for w in split])[["canon_id", "text", "words", "keys"]]


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word of each value, once, as the texts asked for it hold them."""
    for b in batches:
        rows = [(v, w) for v in b["value"] for w in sorted({w for t in asked(v) for w in words(_latin(t))})]
        yield pd.DataFrame(rows, columns=["value", "word"])


def found(results: DataFrame, reference: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(gen_id, field_name, canon_id) of every value with a letter or digit that isn't literally a label."""
    fields = fields or ["answer", "normalized_generation"]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")
    long = results.select("gen_id", pairs).select("gen_id", "x.field_name", "x.value").filter(F.col("value").rlike(r"[\p{L}\p{N}]"))
    long = long.join(reference.select(F.col("label").alias("value")).distinct(), "value", "left_anti")
    counts = long.groupBy("value").agg(F.count("*").alias("n"))
    scratch = Scratch(results.sparkSession, "values")
    counts = scratch.keep(counts)
    mapped = scratch.keep(counts.join(match_values(counts.select("value"), reference), "value"))
    got = spread_join(long, mapped, ["value"], "n", F.col("gen_id"), ["canon_id"])
    return got.select("gen_id", "field_name", "canon_id")
