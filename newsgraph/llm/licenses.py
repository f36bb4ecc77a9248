"""Licence scan: ordered signature rules behind a keyword filter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTES, as_bytes, map_texts
from .license_rules import RULES

#: Phrases looked for as consecutive words, whatever stands between the words.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Rules of this priority or less are hints.
HINT = 20
_GAP = r"(?:[\s,;:()\[\]-]|the\b|version\b|v\.?(?=\s?\d))*"


class Rule:
    __slots__ = ("number", "label", "priority", "keyword", "keywords", "pattern")

    def __init__(self, number: int, line: str):
        self.number = number
        self.label, priority, self.keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        self.priority = int(priority)
        self.keywords = self.keyword.split(", ")
        self.pattern = re.compile(pattern.replace("~", _GAP).replace(" ", r"\s+"))


class Scanner:
    """Compiled rules and the automaton of their keywords."""

    def __init__(self, rules: str = RULES):
        import ahocorasick

        self.rules = [Rule(i, line) for i, line in enumerate(x for x in rules.splitlines() if x.strip())]
        by_keyword: dict[str, list[int]] = {}
        for rule in self.rules:
            for keyword in rule.keywords:
                by_keyword.setdefault(keyword, []).append(rule.number)
        self.keywords = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.keywords.add_word(keyword, numbers)
        self.keywords.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """Start, end and rule of what is left of all matches in a lower-case text, in text order.

        A match goes if another one contains it and is of higher priority, or of the same and longer, or of equal place
        and listed earlier.  Matches that overlap only in part both stay, but a hint goes if any better match overlaps it.
        """
        active: set[int] = set()
        # a keyword's space stands for any white space, as in the patterns
        for _, numbers in self.keywords.iter(" ".join(text.split())):
            active.update(numbers)
        found = [(m.start(), m.end(), r) for n in sorted(active) for r in (self.rules[n],) for m in r.pattern.finditer(text) if m.end() > m.start()]
        # by start, longest first: a match can only be contained in one before it, or in one of equal place
        found.sort(key=lambda d: (d[0], -d[1], -d[2].priority, d[2].number))
        levels = sorted({r.priority for _, _, r in found})
        reach = dict.fromkeys(levels, -1)  # furthest end so far of each priority
        kept: list[tuple[int, int, Rule]] = []
        for start, end, rule in found:
            if not any(p >= rule.priority and reach[p] >= end for p in levels):
                kept.append((start, end, rule))
            reach[rule.priority] = max(reach[rule.priority], end)
        # a longer match of lower priority gives way to one inside it that says more
        better = {p: _Better([(s, e) for s, e, r in kept if r.priority > p]) for p in {r.priority for _, _, r in kept}}
        return [(s, e, r) for s, e, r in kept if not (better[r.priority].overlaps(s, e) if r.priority <= HINT else better[r.priority].within(s, e))]


class _Better:
    """Whether some of the intervals, sorted by start, lie within a range or overlap it."""

    def __init__(self, intervals: list[tuple[int, int]]):
        self.starts = [s for s, _ in intervals]
        self.nearest = list(accumulate(reversed([e for _, e in intervals]), min))[::-1]  # least end from here on
        self.furthest = list(accumulate((e for _, e in intervals), max))

    def within(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, start)
        return at < len(self.starts) and self.nearest[at] <= end

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.furthest[at - 1] > start


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def phrases(words: list[bytes], wanted: dict[bytes, str]) -> list[tuple[int, str]]:
    """First word and label of every place where a phrase's words stand one after another."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in wanted.items():
        at = line.find(phrase)
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(phrase, at + 1)
    return sorted(found)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with what each whole text says of its licence.

    ``n_words``; ``places`` (word number and label of each of ``PHRASES``, in order); ``detections`` (label, priority,
    start and end character) of the rules after suppression; ``labels`` (of both, distinct and sorted); and ``score``,
    the highest priority found over 100 (a phrase counts 60), 0 if nothing is found.  Rules are tried only on a text that
    holds a keyword of theirs, found by one automaton for all; whatever a rule matches holds one.  A null or empty text has no words and
    no finds, repeated rows find the same, and an empty table gives none.  Own columns
    replace kept ones of the same names.
    """
    out = ("n_words bigint, places array<struct<word: bigint, label: string>>, "
           "detections array<struct<label: string, priority: int, start: int, stop: int>>, labels array<string>, score double")

    def make():
        rules, wanted = scanner(), {b" " + p.encode() + b" ": label for p, label in PHRASES.items()}

        def kernel(column: pa.Array) -> list[pa.Array]:
            counts, places, detected, labels, scores = [], [], [], [], []
            for data in as_bytes(column):
                data = data or b""
                words = data.translate(WORD_BYTES).split()
                base = phrases(words, wanted)
                found = rules.detections(data.lower().decode())
                counts.append(len(words))
                places.append([{"word": w, "label": label} for w, label in base])
                detected.append([{"label": r.label, "priority": r.priority, "start": s, "stop": e} for s, e, r in found])
                labels.append(sorted({label for _, label in base} | {r.label for _, _, r in found}))
                scores.append(max([0.0, *(0.6 for _ in base[:1]), *(r.priority / 100 for _, _, r in found)]))
            return [
                pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                pa.array(detected, pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))),
                pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64()),
            ]

        return kernel

    return map_texts(docs, make, out, keep, text)
