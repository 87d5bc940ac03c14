"""Nulls, empty and long texts, ties, repeated rows, empty tables, other columns of clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import brute
from sessionlake.llm import bagminhash, bpe, brown, chat, exact_dedup, merkle, mixing, quality, repeats, toxicity

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, content string, row long, digest string, "
          "score double, size long, key string, sum long, held_out string")
LONG = "wort " * 60_000 + "ende"
TEXTS = [
    (1, "one two three four five six seven eight nine ten " * 6, "a"), (1, "one two three four five six seven eight nine ten " * 6, "a"),
    (2, None, "b"), (3, "", None), (4, "   \n\t", "b"), (None, "x y z", "c"), (None, None, None), (5, LONG, "a"), (6, LONG + " etwas", "c"),
    (7, "Grüße\n\nПривет 🤦🏼‍♂️ world.\n" * 9, "b"), (2**53 + 1, "big id", "a"), (8, "a\u0000b", "c"),
]


def table(spark, rows):
    full = [(i, t, None, s, None, "c", None, "d", None, 7, "k", 1, "h") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (99, 1, 1), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


ALL = sorted((i is None, i or 0) for i, _, _ in TEXTS)


def test_exact(spark, docs):
    got = exact_dedup.exact_groups(docs).collect()
    assert ids(got) == ALL
    white = [r for r in got if r.digest == bytes.fromhex(hashlib.sha256(b"").hexdigest())]
    assert len(white) == 4 and {r.keep_id for r in white} == {4} and [r.kept for r in white].count(True) == 1
    assert sum(r.kept for r in got if r.doc_id == 1) == 1 and {r.group_size for r in got if r.doc_id == 1} == {2}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []


def test_heavy_groups_are_decided_without_the_rest(spark):
    rows = table(spark, [(i, "same text" if i % 3 else f"text {i}", "s") for i in range(300)])
    few = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows, counters=4).collect()}
    many = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows).collect()}
    assert few == many
    digests = exact_dedup.digests(rows)
    assert exact_dedup.frequent(digests, 4).count() == 1
    assert exact_dedup.misra_gries(digests, 4).count() <= 4


def test_mixing(spark, docs):
    sized = mixing.sizes(docs)
    plan = mixing.schedule(sized).collect()
    total = sized.agg(F.sum("size")).first()[0]
    assert sum(r["size"] for r in plan) <= total
    targets = {r.source: r for r in mixing.source_targets(sized).collect()}
    assert abs(sum(r.target for r in targets.values()) - total) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in targets.values())
    assert [targets[s].weight for s in ("a", "b", "c")] == [1, 2, 3] and targets[None].weight == 1
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and taken.count() == len(plan)
    assert mixing.mixed_documents(docs.limit(0)).collect() == [] and mixing.schedule(mixing.sizes(docs.where("text is null"))).collect() == []


def test_merkle(spark, docs):
    got = merkle.with_next(docs).collect()
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got}
    assert by[3].print == by[2].print != by[4].print and by[7].head is not None
    assert by[2].head == by[1].text[:0] and by[5].next_print == by[4].print  # 5 is followed by 4
    assert merkle.with_next(docs.limit(0)).collect() == []
    one = merkle.with_next(table(spark, [(3, "alone", "s")])).collect()
    assert len(one) == 1 and one[0].next_print == one[0].print


def test_fingerprints_locate_edits(spark):
    text = "".join(f"Line {i}. It has a second sentence!\n" for i in range(8))
    other = text.replace("Line 5.", "Line five.")
    r = spark.createDataFrame([(text, other)], "a string, b string").select(
        merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b")).select(
        merkle.changed(F.col("a"), F.col("b")).alias("c"), merkle.likeness(F.col("a"), F.col("b")).alias("l"),
        merkle.likeness(F.col("a"), F.col("a")).alias("s"), (merkle.root(F.col("a")) == merkle.root(F.col("b"))).alias("same")).first()
    assert [(x.section, list(x.paragraphs)) for x in r.c] == [(5, [0])] and 0.7 < r.l < 1 and r.s == 1 and not r.same


@pytest.mark.parametrize("change, want", [
    (lambda t: "New first.\n" + t, [(0, [0])]), (lambda t: t, []), (lambda t: t + "End.\n", [(8, [0])]),
    (lambda t: t.replace("Line 3. It has a second sentence!\n", ""), [(3, [0, 1])]),
    (lambda t: t.replace("Line 2.", "Line two.").replace("Line 6. It has", "Line 6. It had"), [(2, [0]), (6, [1])])])
def test_sections_put_in_or_left_out_move_no_others(spark, change, want):
    text = "".join(f"Line {i}. It has a second sentence!\n" for i in range(8))
    c = spark.createDataFrame([(text, change(text))], "a string, b string").select(
        merkle.changed(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("c")).first().c
    assert [(x.section, list(x.paragraphs)) for x in c] == want


def test_near(spark, docs):
    got = bagminhash.near_classes(docs).collect()
    assert ids(got) == ALL
    rows = [(k, t) for k, (_, t, _) in enumerate(TEXTS)]
    want = brute.near_classes(rows)
    classes = {}
    for (i, t, _), k in zip(TEXTS, range(len(TEXTS))):
        classes.setdefault(want[k], []).append(i)
    ours = {}
    for r in got:
        ours.setdefault((r.class_id, r.class_size), []).append(r.doc_id)
    key = lambda g: sorted((x is None, x or 0) for x in g)
    assert sorted(map(key, ours.values())) == sorted(map(key, classes.values()))
    kept = bagminhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert bagminhash.near_classes(docs.limit(0)).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (1, 1, "assistant", "b"), (2, 5, "system", r"\<|done|> \\"), (2, 5, "system", r"\<|done|> \\")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[2].turns_sha256 == hashlib.sha256((r"system" + "\n" + r"\<|done|> \\" + "\n").encode() * 2).hexdigest()
    assert got[None].n_turns == 1 and got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_bpe(spark, docs):
    got = bpe.encoded_digests(docs, *bpe.vocabulary()).collect()
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == 0 and by[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    kept = bpe.token_ids(docs, *bpe.vocabulary(), keep=("source", "size"))
    assert kept.columns == ["doc_id", "source", "size", "n_tokens", "ids"] and kept.count() == len(TEXTS)


def test_repeats(spark, docs):
    got = repeats.without_repeats(docs).collect()
    assert ids(got) == ALL
    want = brute.without_repeats([(k, (t or "")[:40_000]) for k, (_, t, _) in enumerate(TEXTS)])
    short = repeats.without_repeats(table(spark, [(k, (t or "")[:40_000], "s") for k, (_, t, _) in enumerate(TEXTS)])).collect()
    for r in short:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert sum(s.end - s.begin for s in r.spans) == removed
    assert {r.n_removed == r.n_bytes for r in got if r.doc_id in (1, 5)} == {True}
    assert repeats.without_repeats(docs.limit(0)).collect() == []


def test_brown(spark, docs, monkeypatch):
    monkeypatch.setattr(brown, "ROUNDS", 2)
    got = brown.scored(docs).collect()
    assert ids(got) == ALL and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert brown.scored(docs.limit(0)).collect() == []
    lone = brown.scored(docs.where("doc_id = 2")).collect()
    assert len(lone) == 1


def test_classifiers(spark, docs, labels):
    for run, column in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        got = run(docs, labels).collect()
        assert ids(got) == ALL and all(0 <= r.score <= 1 for r in got)
        assert run(docs.limit(0), labels).collect() == []
        assert len(run(docs, labels.limit(0)).collect()) == len(TEXTS)
    kept = toxicity.drop_toxic(docs, labels, threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
