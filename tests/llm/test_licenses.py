import re
import sys
import time
from re import _parser

from askwright.llm import licenses
from askwright.llm.license_rules import rules


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    joined = f" {' '.join(words)} "
    found = []
    for n, (label, priority, keyword, pattern) in enumerate(rules()):
        if f" {keyword}" not in joined:
            continue
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined):
            start = joined.count(" ", 0, m.start()) - 1
            found.append((start, start + m[0].count(" ") + 1, priority, n, label))
    kept = [d for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and ((e[0], -e[1], e[3]) < (d[0], -d[1], d[3]))) for e in found)]
    starts = [i for i, _ in base]
    base_labels = sorted({x for _, x in base})
    worth = [licenses.CONFIDENCE[d[2]] for d in kept] + [0.8] * bool(base) + [0.0]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(sorted({*base_labels, *(d[4] for d in kept)})), max(worth))


TEXTS = [
    "Some prose.\nLicensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3. GPL v2 or later.",
    "Released under the MIT License. Copyright (c) 2020 X. All rights reserved. ALL  RIGHTS-RESERVED!",
    "Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later and CC-BY, cc by sa 3.0 unported",
    "all rights reservedé; all rights, reserved; cc bye; xcc by; general public licenses",
    "", None, "mit einem Wort © 2021 tous droits réservés", "É" * 50 + " cc by",
    "cc by " * 3000 + "creative commons attribution share alike 4.0 international license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted; neither the name of the X Y nor the names of its contributors may be used to endorse or promote products",
]


def test_rules_are_many_and_carry_their_keywords():
    assert len(rules()) > 250 and len({k for _, _, k, _ in rules()}) > 60
    for _, priority, keyword, pattern in rules():
        re.compile(pattern)
        assert priority in licenses.CONFIDENCE and keyword


def test_keywords_hide_no_match():
    """A pattern matches nothing that its keyword would have gated away."""
    joined = [f" {' '.join(re.findall(licenses.SEPARATORS.replace('[', '[^', 1), (t or '').lower()))} " for t in TEXTS]
    for _, _, keyword, pattern in rules():
        for text in joined:
            assert f" {keyword}" in text or not re.search(f"(?<= )(?:{pattern})(?= )", text), (keyword, pattern)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 1), (3, TEXTS[3], 1)], "doc_id long, text string, labels int")
    found = licenses.report(licenses.scan(docs)).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        assert tuple(r)[1:] == brute(TEXTS[r.doc_id or 0])
    assert licenses.report(licenses.scan(docs.limit(0))).collect() == []


def test_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    found = licenses.report(licenses.scan(docs)).collect()
    assert all(tuple(r)[1:] == brute(texts[r.doc_id]) for r in found) and any(r.n_base for r in found)


def matches(parsed):
    """Matches of a parsed pattern: every alternative, and every optional part both there and not."""
    out = [""]
    for op, arg in parsed:
        if op is _parser.LITERAL:
            part = [chr(arg)]
        elif op is _parser.SUBPATTERN:
            part = matches(arg[3])
        elif op is _parser.BRANCH:
            part = [x for branch in arg[1] for x in matches(branch)]
        elif op is _parser.MAX_REPEAT:
            part = sorted({x * n for n in (arg[0], max(arg[0], 1)) for x in matches(arg[2])})
        else:
            assert op is _parser.IN
            part = [chr(x) for kind, x in arg if kind is _parser.LITERAL] or ["7"]
        out = [a + b for a in out for b in part]
    return out


def test_every_alternative_carries_its_keyword():
    for _, _, keyword, pattern in rules():
        for text in matches(_parser.parse(pattern)):
            assert re.fullmatch(pattern, text) and f" {keyword}" in f" {text} ", (keyword, text)


def test_equals_brute_force_without_keywords(spark, monkeypatch):
    """One match of every alternative of every rule, in texts of their own, against all patterns."""
    texts = ["under the FreeBSD license", "the zlib/libpng license", "publié sous la licence X", "sous la licence", "freebsd licence zlib libpng licence"]
    for _, _, _, pattern in rules():
        parsed = _parser.parse(pattern)
        whole = len(parsed) == 1 and parsed[0][0] is _parser.BRANCH
        texts += [f"x {matches(branch)[0]} y" for branch in (parsed[0][1][1] if whole else [parsed])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.report(licenses.scan(docs)).collect()
    monkeypatch.setattr(sys.modules[__name__], "rules", lambda ungated=[(a, p, "", x) for a, p, _, x in rules()]: ungated)
    assert len(found) == len(texts) > 400
    for r in found:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_long_texts_in_linear_time(spark):
    text = "cc by all rights reserved x " * 8_000 + "licensed under the mit license " * 4_000
    began = time.time()
    (found,) = licenses.report(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert found.n_base == 16_000 and found.first_word == 0 and "mit" in found.labels.split(",") and time.time() - began < 30


def test_trie_reads_the_longest_word():
    words = ["a", "ab c", "ab d", "b", "bcd", "é x", "©"]
    pattern = re.compile(f" (?=({licenses.trie(words)}))")
    assert pattern.findall(" ab c ab d ab x bc bcde é x © é") == ["ab c", "ab d", "a", "b", "bcd", "é x", "©"]
