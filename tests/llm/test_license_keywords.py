from __future__ import annotations

import random
import re
from re import _constants as c
from re import _parser

from minutespark.llm import licenses


def sample(tree, rng):
    """A text of the regex, its optional parts and branches drawn."""
    out = ""
    for op, arg in tree:
        if op == c.LITERAL:
            out += chr(arg)
        elif op == c.NOT_LITERAL:
            out += "x"
        elif op == c.IN:
            kind, value = rng.choice(arg)
            out += chr(value if kind == c.LITERAL else rng.randint(*value)) if kind != c.NEGATE else "x"
        elif op == c.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op == c.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op == c.MAX_REPEAT:
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        else:
            assert op in (c.ASSERT_NOT, c.AT), op
    return out


def test_every_match_holds_a_keyword():
    rng = random.Random(1)
    table = licenses.rules()
    words = {}
    for *_, label, _, word, regex in table:
        words.setdefault((label, regex), set()).add(word)
    for (_, regex), held in words.items():
        tree = _parser.parse(regex)
        for _ in range(60):
            text = sample(tree, rng)
            assert any(f" {w}" in f" {text}" for w in held), (text, held)


def test_names_and_clauses_alone(spark):
    texts = {
        "gpl-3": "This library is GPL v3",
        "lgpl-2-1": "It is LGPL 2.1.",
        "agpl-3": "AGPLv3",
        "bsd-3": "Neither the name of the author nor the names of its contributors may be used to endorse",
        "apache-2": "you may not use this file except in compliance with the License",
        "boost-1": "Boost Software License - Version 1.0 - August 17th, 2003",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r.detections for r in licenses.scan(df).collect()}
    for i, label in enumerate(texts):
        assert [d.label for d in got[i]] == [label], texts[label]
    assert got[5][0].tier == 1
    both = spark.createDataFrame([(1, "GPL v3 license, GNU General Public License v3")], "doc_id long, text string")
    assert [d.label for d in licenses.scan(both).first().detections] == ["gpl-3", "gpl-3"]


def resolved(text):
    """The detections by brute force over all rules and matches."""
    words = " " + "".join(f"{w} " for w in re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    found = []
    for o, tier, label, _, _, regex in licenses.rules():
        at = 0
        while m := re.compile(f" {regex}(?= )").search(words, at):
            found.append((m.start(), -m.end(), tier, o, label, m.end()))
            at = m.end()
    found.sort()
    return [f for i, f in enumerate(found) if not any(g[5] >= f[5] and g[2] <= f[2] for g in found[:i])]


def test_detections_equal_brute_force(spark):
    """Every rule's own sample between other words, and a text of them all."""
    rng = random.Random(3)
    table = licenses.rules()
    assert len(table) > 200 and len({r[5] for r in table}) > 200
    texts = [f"Some {sample(_parser.parse(r[5]), rng)} follows {sample(_parser.parse(rng.choice(table)[5]), rng)}" for r in table]
    texts.append(" and\n".join(texts) * 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(d.start, -d.end, d.tier, d.rule, d.label, d.end) for d in r.detections] for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == resolved(t), t[:200]
    assert len(got[len(texts) - 1]) > 500


def test_many_matches_of_one_rule(spark):
    n = 20_000
    df = spark.createDataFrame([(1, "all rights reserved. " * n)], "doc_id long, text string")
    r = licenses.scan(df).select("n_words", "detections").first()
    assert r.n_words == 3 * n and len(r.detections) == n and r.detections[-1].end == len(" all rights reserved") * n
