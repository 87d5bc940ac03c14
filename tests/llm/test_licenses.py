"""License scan: every rule matches what it says, next to a plain program; edge cases."""

import random
import re
import re._parser as parser

from sessionlake.llm import licenses
from sessionlake.llm.license_rules import BASE, RULES, SIGNATURES, parsed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sample(tree, rng):
    """A string that the parsed expression matches."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "NOT_LITERAL":
            out.append("q")
        elif name == "SUBPATTERN":
            out.append(sample(arg[3], rng))
        elif name == "BRANCH":
            out.append(sample(rng.choice(arg[1]), rng))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += [sample(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 2)))]
        elif name == "IN":
            if str(arg[0][0]) == "NEGATE":
                out.append("q")
            else:
                kind, value = rng.choice(arg)
                out.append(chr(value if str(kind) == "LITERAL" else rng.randint(*value)))
        else:
            raise AssertionError(name)
    return "".join(out)


def plain(text):
    """(words, detections) with (start, end, priority, rule, label) by trying all rules."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    joined = "".join(f"<{w}>" for w in words)
    found = []
    for n, p, label, _, pattern, _ in RULES:
        for m in re.finditer(pattern, joined):
            found.append((joined.count("<", 0, m.start()), joined.count("<", 0, m.end()), p, n, label))
    kept = [d for d in found if d[2] == 0 or not any(
        o is not d and o[0] <= d[0] and o[1] >= d[1] and (o[2] < d[2] or o[2] == d[2] and (o[:2] != d[:2] or o[3] < d[3])) for o in found)]
    return len(words), found, kept


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "l", 2, "s") for i, t in rows], "doc_id long, text string, row long, label string, start long, labels string")
    got = [tuple(r) for r in licenses.scan_licenses(docs).collect()]
    want = []
    for i, t in rows:
        n, found, kept = plain(t)
        base = [d for d in found if d[2] == 0]
        score = {r[0]: r[5] for r in RULES}
        want.append((i, n, len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})),
                     ",".join(sorted({d[4] for d in kept})), len(kept), max((score[d[3]] for d in kept), default=0.0)))
    assert sorted(got, key=str) == sorted(want, key=str)


def samples(seed, each=2):
    rng = random.Random(seed)
    for p, label, keywords, expression in parsed(BASE) + parsed(SIGNATURES):
        tree = parser.parse(expression)
        for _ in range(each):
            yield p, label, keywords.split("+"), sample(tree, rng)


def test_rules_are_many_and_their_keywords_are_in_all_they_match():
    assert len(RULES) > 250
    for p, label, keywords, text in samples(1, 20):
        assert set(keywords) <= set(text.split()), (label, keywords, text)
        assert any(re.search(r[4], "".join(f"<{w}>" for w in text.split())) for r in RULES if r[1:3] == (p, label)), text


def test_each_rule_next_to_a_plain_program(spark):
    rng = random.Random(5)
    rows = []
    for i, (_, _, _, text) in enumerate(samples(2)):
        seps = [" ", "\n", " - ", "/", ". ", "\t(", "_"]
        mangled = "".join(w.upper() if rng.random() < 0.3 else w for w in re.split("( )", text)).replace(" ", rng.choice(seps))
        rows.append((i, f"Wort {mangled}, nach. {text if i % 3 else 'mit summit license'}"))
    check(spark, rows)


def test_resolution(spark):
    check(spark, [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. Apache License"), (3, "cc-by-nc-sa 4.0 cc by nc CC BY NC cc by nc"),
                  (4, "gnu general public license version 3 or later; GPL; the mit license " * 40)])


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (2, ""), (None, "under the mit license"), (None, None), (3, "<<>>{}|&"), (4, "under the mit license " * 3000), (5, "{<cc>} {by} \u0000nc ✂ é"),
                  (6, "summit license under the mit licensee"), (7, "x" * 300_000 + " cc by nc")])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(docs).collect() == []


def test_spans_are_those_of_the_text(spark):
    docs = spark.createDataFrame([(1, "This is Released under the MIT License today")], "doc_id long, text string")
    rows = {(r.label, r.start, r.end, r.priority, r.kept) for r in licenses.detections(licenses.scanned(docs)).collect()}
    assert ("mit", 3, 7, 0, True) in rows and ("mit", 2, 7, 2, True) in rows and ("mit", 4, 7, 4, False) in rows
