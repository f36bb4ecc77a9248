"""Rules, suppression and phrases."""

import random
import time
from re import _constants as C, _parser

import pytest

from newsgraph.llm import licenses

CASES = [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("under the GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("GNU Affero General Public License\nversion 3", {"agpl-3.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
    ("Creative Commons Attribution-ShareAlike 4.0", {"cc-by-sa"}),
    ("CC BY 4.0", {"cc-by-4.0"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("the 2-clause BSD thing", {"bsd-2-clause"}),
    ("Mozilla Public License, v. 2.0", {"mpl-2.0"}),
    ("All rights reserved.", {"reserved"}),
    ("Copyright (c) 2021 X. All rights reserved", {"copyright-notice", "reserved"}),
    ("Boost Software License - Version 1.0", {"bsl-1.0"}),
    ("released into the public domain", {"public-domain"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software", {"mit"}),
    ("dual-licensed, GPLv2 or Apache 2.0? apache license 2.0", {"dual-licence", "gpl-2.0", "apache-2.0"}),
    ("nothing of the kind about apaches and mitts", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_labels(text, want):
    assert {r.label for _, _, r in licenses.scanner().detections(text.lower())} == want


def sample(tree, draw):
    """A text that a parsed pattern matches but for its assertions, of random alternatives, repeats and white space."""
    out = []
    for op, value in tree:
        if op is C.IN and value[0][0] is not C.NEGATE:
            op, value = draw.choice(value)
        if op is C.LITERAL:
            out.append(chr(value))
        elif op is C.RANGE:
            out.append(chr(draw.randint(*value)))
        elif op is C.CATEGORY and value is not C.CATEGORY_NOT_SPACE:
            out.append(draw.choice({C.CATEGORY_SPACE: " \n\t", C.CATEGORY_DIGIT: "0123456789"}[value]))
        elif op in (C.IN, C.ANY, C.CATEGORY, C.NOT_LITERAL):
            out.append("x")
        elif op is C.BRANCH:
            out.append(sample(draw.choice(value[1]), draw))
        elif op is C.SUBPATTERN:
            out.append(sample(value[3], draw))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += [sample(value[2], draw) for _ in range(draw.randint(value[0], min(value[1], value[0] + 2)))]
        else:
            assert op in (C.AT, C.ASSERT)
    return "".join(out)


def test_whatever_a_rule_matches_holds_a_keyword():
    draw, s = random.Random(5), licenses.scanner()
    for rule in s.rules:
        tree = _parser.parse(rule.pattern.pattern)
        texts = [t for t in (sample(tree, draw) for _ in range(200)) if rule.pattern.search(t)]
        assert texts, rule.label
        for text in texts:
            tried = {n for _, numbers in s.keywords.iter(" ".join(text.split())) for n in numbers}
            assert rule.number in tried, (rule.label, text)


@pytest.mark.parametrize("text,want", [
    ("GNU Free\nDocumentation License", {"gfdl"}),
    ("It is in the public\r\n  domain.", {"public-domain"}),
    ("provided AS\tIS without warranty of any kind", {"as-is"}),
    ("do what the fork you want to public licence", {"wtfpl"}),
    ("Licence Ouverte", {"etalab-2.0"}),
    ("End User License Agreement", {"proprietary"}),
    ("Unauthorised copying of this file", {"proprietary"}),
    ("the simplified licence", {"bsd-2-clause"}),
    ("may you do good and not evil", {"sqlite-blessing"}),
    ("see the licence file for details", {"see-licence"}),
])
def test_labels_that_a_narrow_keyword_hid(text, want):
    assert {r.label for _, _, r in licenses.scanner().detections(text.lower())} == want


def test_rules():
    rules = licenses.scanner().rules
    assert len(rules) > 200 and all(r.keyword == r.keyword.lower() and 0 < r.priority <= 100 for r in rules)
    assert len({(r.label, r.pattern.pattern) for r in rules}) == len(rules)


def test_a_contained_match_gives_way_by_priority():
    s = licenses.Scanner("wide | 50 | alpha | alpha beta gamma\nhigh | 90 | beta | beta\nlow | 10 | gamma | gamma\nfar | 30 | delta | gamma delta")
    text = "alpha beta gamma delta beta"
    assert [(r.label, text[a:b]) for a, b, r in s.detections(text)] == [("high", "beta"), ("far", "gamma delta"), ("high", "beta")]
    same = licenses.Scanner("first | 50 | x | xx\nsecond | 50 | x | xx\nthird | 60 | q | q")
    assert [r.label for _, _, r in same.detections("xx")] == ["first"]


def test_phrases():
    wanted = {b" a b ": "ab", b" b a ": "ba"}
    assert licenses.phrases(b"a b a b".split(), wanted) == [(0, "ab"), (1, "ba"), (2, "ab")]
    assert licenses.phrases([], wanted) == []


def test_scan(spark, make_docs):
    rows = [(1, "X: CC-BY text, CC  by. All\nRIGHTS reserved"), (2, None), (3, ""), (4, "word " * 50_000 + "general, public License"), (4, "repeat"), (None, "CC by"), (5, "É cc éby by")]
    got = {(r.doc_id, (r.text or "")[:9]): r for r in licenses.scan(make_docs(rows, clash=["labels", "score"]), ["doc_id", "text", "labels"]).collect()}
    assert len(got) == len(rows)
    one = got[1, "X: CC-BY "]
    assert [(p["word"], p["label"]) for p in one.places] == [(1, "cc-by"), (4, "cc-by"), (6, "reserved")] and one.n_words == 9
    assert {"cc-by", "reserved"} <= set(one.labels) and one.labels == sorted(set(one.labels)) and 0 < one.score <= 1
    for key in ((2, ""), (3, "")):
        assert got[key].n_words == 0 and got[key].labels == [] and got[key].score == 0.0 and got[key]["detections"] == []
    assert [p["word"] for p in got[4, "word word"].places] == [50_000]
    assert got[5, "É cc éby "].places == []
    assert licenses.scan(make_docs(rows).limit(0), ["doc_id"]).count() == 0


def slow(text):
    """Every rule on the text, and every pair of matches, without keywords."""
    rules = licenses.scanner().rules
    found = [(m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda d: (d[0], -d[1], -d[2].priority, d[2].number))
    kept = [d for i, d in enumerate(found) if not any(o[0] <= d[0] and o[1] >= d[1] and o[2].priority >= d[2].priority for o in found[:i])]
    out = []
    for s, e, r in kept:
        better = [(a, b) for a, b, o in kept if o.priority > r.priority]
        if not any((a < e and b > s) if r.priority <= licenses.HINT else (a >= s and b <= e) for a, b in better):
            out.append((s, e, r.number))
    return out


def test_detections_equal_all_rules_on_all_pairs():
    draw = random.Random(11)
    pieces = [c for c, _ in CASES] + ["gpl", "license", "free software", "apache", "mit", "version 2", "\n", "as is", "copyright", "bsd 3-clause"]
    for _ in range(60):
        text = " ".join(draw.choices(pieces, k=draw.randrange(1, 25))).lower()
        assert [(s, e, r.number) for s, e, r in licenses.scanner().detections(text)] == slow(text)


def test_many_detections():
    text = "licensed under the mit license. all rights reserved. gpl-3.0 or cc by 4.0\n" * 25_000
    start = time.process_time()
    found = licenses.scanner().detections(text)
    assert len(found) > 90_000 and time.process_time() - start < 10
