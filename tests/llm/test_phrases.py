"""Phrase collocations next to counting every gram; edge cases."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from sessionlake.llm import phrases


def plain(rows, min_count=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {g: n for g, n in count.items() if len(g[1]) > 1 and n >= min_count}
    longest = defaultdict(int)
    for (lang, w), n in found.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longest[lang, part] = max(longest[lang, part], n)
    by_lang = defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * longest[lang, w] >= 50 * a and longest[lang, w]:
            continue
        score, _, l, r = min((1_000_000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, held in by_lang.items() for k, (s, a, p, l, r) in enumerate(sorted(held)[:top]))


def check(spark, rows, **options):
    docs = spark.createDataFrame([(t, g, 1, "x", "p", 2) for g, t in rows], "text string, lang string, n long, gram string, phrase string, f long")
    got = phrases.collocations(docs, **options)
    assert sorted(tuple(r)[:8] for r in got.collect()) == plain(rows, **options)
    return got


def test_random_texts(spark):
    rng = random.Random(3)
    words = ["the", "of", "Über", "x-y", "a", "licence", "is", "ß", "NEW", "york"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    check(spark, rows)
    check(spark, rows, min_count=3, top=7)


def test_long_unary_paths(spark):
    line = " ".join(f"w{i}" for i in range(70))
    got = check(spark, [("en", f"{line}. other start {line}")] * 6 + [("en", "w1 w2 w9")])
    found = {r.phrase: r.path_words for r in got.collect()}
    # w1 w2 goes on to w9 once, so the paths end at and start from that node.
    assert found["w5 w6 w7"] == 69 and found["w0 w1 w2"] == 3


def test_edges(spark):
    check(spark, [(None, None), ("en", ""), ("en", " \t.,;"), ("und", "a b"), (None, "a b")] + [(None, "a b")] * 9 + [("en", "q " * 30_000), ("fr", "à b c\x85d " * 12)])
    check(spark, [("en", "same words here")] * 10 + [("en", "same words")] * 10)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_large_products_are_exact(spark):
    big = 3_000_000_000_000
    counted = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "", 0, 3 * big)], "lang string, phrase string, words int, f long")
    found = phrases.scored(phrases.candidates(counted), counted).first()
    assert found.score == 1_000_000 * (big - 1) ** 2 // (big * (big + 7)) and (found.l, found.r) == (big, big + 7)


def test_shorter_counts_come_from_flow(spark):
    docs = spark.createDataFrame([("en", "a b c. a b. a")] * 10, "lang string, text string")
    got = {r.phrase: r.f for r in phrases.counts(phrases.edges(docs)).collect()}
    assert got == {"": 60, "a": 30, "b": 20, "c": 10, "a b": 20, "b c": 10, "a b c": 10}
    found = {(r["head"], r["word"]): r["n"] for r in phrases.edges(docs).groupBy("head", "word").agg(F.sum("n").alias("n")).collect()}
    assert found == {("a b\nen", "c"): 10, ("a b\nen", ""): 10, ("b c\nen", ""): 10, ("a\nen", ""): 10, ("b\nen", ""): 10, ("c\nen", ""): 10}


def test_salts_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "."]) for _ in range(rng.randint(0, 80)))) for _ in range(200)]
    monkeypatch.setattr(phrases, "HOT", 1 / 300)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert len(phrases.hot_pairs(docs)) > 3
    check(spark, rows, min_count=5)


def test_windows_change_nothing():
    rng = random.Random(9)
    words = [rng.choice([b"a", b"b", "ß".encode(), b"."]) for _ in range(500)]
    want, got, stream = Counter(), Counter(), phrases._Stream("en")
    piece = []
    for w in [*words, b"."]:
        if w == b".":
            want.update(tuple(piece[i:i + 3]) for i in range(len(piece)))
            piece = []
        else:
            piece.append(w.decode())
    for at in range(0, len(words), 3):
        stream.add(words[at:at + 3])
        batches = list(stream.grams(pa.array(["a b\nen"]), at + 3 >= len(words))) if rng.random() < 0.3 or at + 3 >= len(words) else []
        for b in batches:
            for r in b.to_pylist():
                assert (r["salt"] > 0) == (r["head"] == "a b\nen")
                got[tuple((r["head"].removesuffix("\nen") + " " + r["word"]).split())] += r["n"]
    assert got == want
