"""The Merkle manifest next to a plain program; edge cases."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row long, digest string, rank long, size long, up string, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root over ``nodes``, and for each node its levels as (left, right)."""
    levels, at, k = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(k) > 1:
        for i, a in enumerate(at):
            run = k[a // 16 * 16:a // 16 * 16 + 16]
            levels[i].append(("".join(run[:a % 16]), "".join(run[a % 16 + 1:])))
        k = [sha("".join(k[i:i + 16])) for i in range(0, len(k), 16)]
        at = [a // 16 for a in at]
    return k[0], levels


def plain(rows):
    order = lambda r, h: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, h)
    keyed = sorted(((r, leaf(r)) for r in rows), key=lambda x: order(*x))
    groups = [list(g) for _, g in groupby(keyed, key=lambda x: x[0][1])]
    low = [climb([h for _, h in g]) for g in groups]
    root, high = climb([sub for sub, _ in low])
    out = []
    for g, (sub, levels), above in zip(groups, low, high):
        for (r, h), own in zip(g, levels):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            cur = leaf((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))) if tampered else h
            for left, right in own + above:
                cur = sha(left + cur + right)
            out.append((r[0], h, sub, root, sha("".join(a + b for a, b in own + above)), cur, cur == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3, "u", "l") for r in rows], SCHEMA)


def result(spark, monkeypatch, docs):
    monkeypatch.setattr(manifest, "load", lambda *_: docs)
    got = manifest.op13_manifest(spark, "").collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


EDGES = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", "en", 4, "Abcd"), (None, "a", None, None, None), (2, None, "de", None, ""),
         (3, None, None, 5, "ÄÖ Ü"), (None, None, None, None, None), (4, "", "x", 1, "Q"), (5, "é", "x", 1, "Long " * 50_000), (6, "z", "", -7, "a\u0000B")]


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (16, 17, 1), (300, 1, 40, 5)])
def test_small_sources(spark, monkeypatch, sizes):
    rows = [(7 * d + s, f"s{s}", "en", d, f"Text {d % 11} of S{s}") for s, n in enumerate(sizes) for d in range(n)]
    assert result(spark, monkeypatch, table(spark, rows)) == plain(rows)


def test_many_sources_and_high_trees(spark, monkeypatch):
    rows = [(d, "hot", "en", d, f"T{d}") for d in range(4500)] + [(d, f"s{d:03d}", None, 1, "Mono") for d in range(270)]
    assert result(spark, monkeypatch, table(spark, rows)) == plain(rows)


def test_nulls_repeats_long_texts_and_clashing_names(spark, monkeypatch):
    assert result(spark, monkeypatch, table(spark, EDGES)) == plain(EDGES)


def test_empty_table(spark, monkeypatch):
    assert result(spark, monkeypatch, table(spark, EDGES).limit(0)) == []


def test_manifest_of_columns_of_ones_own(spark):
    docs = spark.createDataFrame([(i, f"g{i % 3}", i * i) for i in range(40)], "key long, grp string, value long")
    got = manifest.manifest(docs, ("key", "value"), "key", "grp")
    assert got.where(manifest.folded(F.col("leaf"), F.col("levels")) != F.col("root")).isEmpty() and got.count() == 40
    assert got.where(manifest.folded(F.sha2(F.lit("x"), 256), F.col("levels")) == F.col("root")).isEmpty()
