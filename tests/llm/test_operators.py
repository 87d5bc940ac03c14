"""The operators next to independent programs, round trips and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from pyspark.sql import functions as F
from sessionlake.llm import bagminhash, bpe, brown, catalog, chat, kernel, quality, repeats, toxicity
from sessionlake.llm.common import load

SF = "/root/testdata/sf0.001"
LETTERS = st.text(alphabet="ab<|turn>s/[INST]\\ é漢\n", max_size=60)


def test_kernel_hashes_do_not_depend_on_the_place():
    raw = np.frombuffer(b"one two one  three two ", np.uint8)
    starts, stops = kernel.runs(raw, kernel.NOT_WHITE)
    h = kernel.hashes(raw, starts, stops)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


# Chat formatting.


def test_template_language():
    source = ("{# note #}{% set n = 'a' + 'b' %}{% for m in messages %}{% if not loop.first %}, {% endif %}{{ loop.index0 }}:{{ m.role | upper }}"
              "{% if m['text'] == 'x' or m.text in 'yz' %}!{% elif 1 < 2 and m.none %}?{% else %}.{% endif %}{% endfor %}{{ n }}{{ missing }}")
    out, spans = chat.rendered(source, messages=iter([{"role": "a", "text": "x"}, {"role": "b", "text": "q"}]))
    assert out == "0:A!, 1:B.ab" and spans == []


def test_constants_are_folded():
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{{ 'E' | lower }}")) == [("text", "abcde")]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f(1) }}", "{% for x of y %}{% endfor %}", "{{ x | eval }}", "{% if x %}", "{{ 'a", "{{ }}", "{% end %}"])
def test_what_is_not_in_the_language_is_refused(bad):
    with pytest.raises(chat.TemplateError):
        chat.fold(chat.parse(bad))
        raise chat.TemplateError if "__class__" in bad and chat.rendered(bad, x={})[0] == "" else AssertionError


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|says|>\\"]), LETTERS), max_size=5), st.integers(1, 7))
def test_formatted_conversations_read_back(turns, size):
    messages = [{"role": r, "text": t} for r, t in turns]
    out, spans = chat.rendered(chat.TEMPLATE, messages=messages)
    flags = np.zeros(len(out), bool)
    for a, b in spans:
        flags[a:b] = True
    cut, k = [], 0
    while k < len(out):  # chunks cut anywhere, one kind of text each
        e = k + 1
        while e < min(len(out), k + size) and flags[e] == flags[k]:
            e += 1
        cut.append((out[k:e], bool(flags[k])))
        k = e
    got = list(chat.read_back(cut))
    assert [(r, t) for r, t, _ in got] == turns
    assert [g for *_, g in got] == [t if r == "assistant" else "" for r, t in turns]


# Byte-level BPE.


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(bpe.vocabulary()[0]), bpe.vocabulary()[1])


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=encoder.ranks.rank, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80), more=st.text(max_size=20))
def test_bpe_is_what_the_library_gives(encoder, library, text, more):
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()
    assert encoder.extend(text, ids, more) == encoder.encode(text + more)


@settings(max_examples=100, deadline=None)
@given(a=st.binary(max_size=40), b=st.binary(max_size=40))
def test_prefixes_append_and_edit(encoder, a, b):
    p = bpe.Prefixes(encoder.ranks, a)
    p.append(b)
    assert p.tokens() == bpe.Prefixes(encoder.ranks, a + b).tokens() and p.tokens(len(a)) == bpe.Prefixes(encoder.ranks, a).tokens()
    kept = p.edit(a + a)
    assert p.tokens() == bpe.Prefixes(encoder.ranks, a + a).tokens() and kept >= len(a)


# Signatures.


def test_signatures_are_unbiased():
    rng = random.Random(4)
    off = []
    for k in range(60):
        a = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 300))] * (1 + k % 3)
        b = [w if rng.random() > 0.03 else "new" for w in a]
        true = brute.shingles(" ".join(a)), brute.shingles(" ".join(b))
        want = sum((true[0] & true[1]).values()) / sum((true[0] | true[1]).values())
        _, chunk, ends = next(kernel.chunks([" ".join(a), " ".join(b)], 1 << 30))
        text, shingle, weight = bagminhash.shingles(chunk, ends)
        assert math.isclose(bagminhash.similarity(*[(shingle[text == i], weight[text == i]) for i in (0, 1)]), want)
        times = bagminhash.signatures(text, shingle, weight, 2, 256)
        off.append((times[0] == times[1]).mean() - want)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_near_classes_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SF, "documents").collect()]
    rows += [(10_000 + k, t[:-9] + " tail" + str(k)) for k, (_, t) in enumerate(rows) if len(t) > 700]
    rows += [(20_000 + k, "shared words of one family that goes on and on " * 9 + f"and ends with {k}") for k in range(60)]
    got = bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.near_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_components_go_on_from_labels(spark, monkeypatch):
    rng, rounds, stored = random.Random(9), [], bagminhash.stored
    monkeypatch.setattr(bagminhash, "stored", lambda frame, name: rounds.append(name) or stored(frame, name))
    links = [(rng.randrange(60), rng.randrange(60, 120)) for _ in range(50)] + [(k + 1, k) for k in range(200, 230)] + [(k, 300) for k in range(301, 400)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: y for x, y in label.items() if x != y}
    first = bagminhash.components(frame(links[::2]))
    got = bagminhash.components(frame(links[1::2]), first).collect()
    assert len(got) == len(want) and {r.cid: r.label for r in got} == want
    again = bagminhash.components(frame(links[:3]), bagminhash.components(frame(links))).collect()
    assert {r.cid: r.label for r in again} == want
    rounds.clear()
    assert bagminhash.components(frame([])).collect() == []
    bagminhash.components(frame(links[-99:]))
    assert len(rounds) == 2  # what is a star already takes one round


# Repeated passages.


def test_merged_transforms_are_those_of_all():
    rng = random.Random(5)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(2, 7))]
        half = len(strings) // 2
        (left, _), (right, _) = repeats.transform(strings[:half]), repeats.transform(strings[half:])
        which, common = repeats.merged(left, right, (half, len(strings) - half), 30)
        both = np.empty(len(which), np.uint16)
        both[~which], both[which] = left, right
        assert both.tolist() == repeats.transform(strings)[0].tolist()
        suffixes = sorted((tuple(b + 1 for b in s[i:]) + (0,), k) for k, s in enumerate(strings) for i in range(len(s) + 1))
        flat = [s[:-1] for s, _ in suffixes]
        prefix = [0] + [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(flat, flat[1:])]
        assert common.tolist() == prefix
        for depth in (1, 2, 3, 5):
            shard, at = repeats.alike(left, right, depth)
            ours = sorted(zip(shard.tolist(), at.tolist()))
            near = [max(prefix[i], prefix[i + 1] if i + 1 < len(prefix) else 0) >= depth for i in range(len(prefix))]
            rank = np.where(which, np.cumsum(which) - 1, np.cumsum(~which) - 1)
            assert ours == sorted((bool(which[i]), int(rank[i])) for i in range(len(which)) if near[i])


def test_merge_follows_only_what_starts_depend_on(monkeypatch):
    asked, whole = [], repeats.alike
    monkeypatch.setattr(repeats, "alike", lambda a, b, depth, wanted: asked.append(int(wanted.sum())) or whole(a, b, depth, wanted))
    rng = random.Random(8)
    for length in (1, 2, 3, 4, 6, 7, 12):
        for n in (1, 2, 5, 9):
            counts = [rng.randrange(1, 12) for _ in range(n)]
            base = bytes(rng.choice(b"ab\x00\xff") for _ in range(40))
            strings = [(base[rng.randrange(20):] + base)[:c + length - 1] for c in counts]
            seen = Counter(s[i:i + length] for s, c in zip(strings, counts) for i in range(c))
            got = repeats.repeated_starts(strings, np.array(counts), length)
            assert [m.tolist() for m in got] == [[seen[s[i:i + length]] > 1 for i in range(c)] for s, c in zip(strings, counts)]
            assert asked.pop() == sum(counts)


@pytest.mark.parametrize("many", [4096, 2])
def test_repeats_of_a_table(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rows = [(r.doc_id, r.text) for r in load(spark, SF, "documents").collect()][:80]
    part = rows[0][1][:260]
    rows += [(10_000 + k, f"head {k} " * (k + 1) + part[k:] + f" tail {k}") for k in range(20)] + [(11_000, "a" * 900), (11_001, "ab" * 300)]
    want = brute.without_repeats(rows)
    for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id


# Language model.


def test_language_model(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in catalog.queries()["op1_brown_lm"](spark, SF).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: [*brute.WORD.findall((t or "").translate(lower)), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in split(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        w = split(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(w), sum(count[x] > 0 for x in w), n, held[i])
        assert math.isclose(got[i].base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    total = lambda c, h: sum(getattr(r, c) for r in got.values() if r.held_out == h)
    assert total("score", True) > total("base_score", True) and total("score", False) > total("base_score", False)


def test_class_probabilities_add_up():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, brown.CLASSES, brown.UNITS)
    after = rng.integers(0, 3, (brown.UNITS, brown.CLASSES)).astype(float)
    moves, emits = brown.probabilities(classes, brown.table_of(classes, after), after.sum(axis=1))
    assert np.allclose((10**moves).sum(axis=1), 1)
    present = np.unique(classes)
    assert np.allclose(np.bincount(classes, weights=10**emits, minlength=brown.CLASSES)[present], 1)


def test_exchange_raises_the_likelihood(monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 4)
    rng = np.random.default_rng(1)
    units = np.zeros(4000, int)
    for k in range(1, len(units)):  # two kinds of words take turns
        units[k] = rng.integers(0, 20) + 20 * (units[k - 1] < 20)
    classes = np.arange(40) % 4
    counts = lambda c: (np.zeros((40, 4)), np.zeros((40, 4)))

    def neighbours(c):
        after, before = counts(c)
        np.add.at(after, (units[:-1], c[units[1:]]), 1)
        np.add.at(before, (units[1:], c[units[:-1]]), 1)
        return after, before
    first = brown.likelihood(brown.table_of(classes, neighbours(classes)[0]))
    for _ in range(4):
        classes = brown.exchange(classes, *neighbours(classes), rng.permutation(40)[:20])
    assert brown.likelihood(brown.table_of(classes, neighbours(classes)[0])) > first


def test_best_class_of_each_tail_word_is_that_of_all_tries():
    rng = np.random.default_rng(3)
    table = rng.integers(200, 400, (brown.CLASSES, brown.CLASSES)).astype(float)
    table += table.T  # a class is entered as often as it is left
    owner = np.repeat(np.arange(30), 4)
    five = np.array([1 + rng.permutation(brown.CLASSES - 1)[:5] for _ in range(30)])  # no two entries in one cell
    slot, now = (five[:, :4] + [0, 0, brown.CLASSES, brown.CLASSES]).ravel(), five[:, 4]
    n = np.tile([3, 2, 1, 4], 30)
    got = brown.best_classes(owner, slot, n, now, table)
    for u in range(30):
        def moved(b):
            t = table.copy()
            for s, k in zip(slot[owner == u], n[owner == u], strict=True):
                for c, sign in ((now[u], -1), (b, 1)):
                    t[(s, c) if s < brown.CLASSES else (c, s - brown.CLASSES)] += sign * k
            return brown.likelihood(t)
        tried = [moved(b) for b in range(1, brown.CLASSES)]
        assert moved(got[u]) >= max(tried) - 1e-6


def test_each_training_word_beyond_the_head_has_a_class_of_its_own(spark):
    rng = np.random.default_rng(5)
    head = [f"h{k}" for k in range(brown.HEAD)]
    # Two kinds of tail words of the same ending and length: one stands between a's, one between b's.
    tail = {k: f"{'xy'[k % 2]}{k:04d}ing" for k in range(200)}
    sides = [head[:4000], head[4000:]]
    some = lambda k: sides[k % 2][rng.integers(0, 40)]
    said = [" ".join(head) for _ in range(3)] + [f"{some(k)} {w} {some(k)}" for k, w in tail.items() for _ in range(2)]
    runs = [" ".join(np.array(side)[rng.integers(0, 40, 400)]) for side in sides for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(said + runs)), "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, _ = brown.vocabulary(docs)
    placed = brown.sequences(docs, model)
    classes, table, _ = brown.clustered(placed, model, 2)
    words, pairs, _, after = brown.tail_clustered(placed, model, classes, table)
    got = {np.int64(r.word).view(np.uint64): r for r in words.collect()}
    chunk, ends = next(kernel.chunks([" ".join(tail.values())], 1 << 60))[1:]
    found, unit, _ = brown.tokens(chunk, ends)
    found, unit = found[:-1], unit[:-1]
    assert len(got) == 200 and all(got[w].n == 2 for w in found)
    assert len(set(unit.tolist())) == 1
    assert len({got[w].c for w in found}) > 1
    assert brown.likelihood(after) > brown.likelihood(table)


def test_tail_words_beyond_the_broadcast_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b{k % 7} c d{k % 11} e{k % 5} f{k % 3} g") for k in range(60)] + [(90, None), (91, "new words b1 only")], "doc_id long, text string")
    monkeypatch.setattr(brown, "HEAD", 6)
    monkeypatch.setattr(brown, "UNITS", 1 + 6 + brown.SHAPES)
    shape = brown.tokens

    def tokens(chunk, ends):
        word, unit, count = shape(chunk, ends)
        return word, np.where(unit > 0, (unit - 1) % brown.SHAPES + 7, 0), count
    tokens.__module__ = "__main__"
    monkeypatch.setattr(brown, "tokens", tokens)
    several = [{r.doc_id: r for r in brown.scored(docs).collect()}]
    held = brown.frequent
    monkeypatch.setattr(brown, "frequent", lambda words: held(words, 12))
    several.append({r.doc_id: r for r in brown.scored(docs).collect()})
    for k, r in several[0].items():
        o = several[1][k]
        assert (r.n_tokens, r.n_known) == (o.n_tokens, o.n_known)
        assert math.isclose(r.base_score, o.base_score, rel_tol=1e-9) and math.isclose(r.score, o.score, rel_tol=1e-9)


# Classifiers.


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "f32", np.float64)
    rng = np.random.default_rng(0)
    m = {k: v.astype(float) for k, v in toxicity.initial(3).items()}
    _, chunk, ends = next(kernel.chunks(["hello big world of words", "a", "", "x y z " * 30], 1 << 60))
    w = toxicity.words(chunk, ends)
    index, _ = toxicity.windows(w["sequence"], w["text"], 4, len(w["word"]))
    x, y, cache = toxicity.inputs(m, w), rng.random(len(index)), {}
    logits = toxicity.forward(m, x, index, cache)
    grads, dx = toxicity.backward(m, x, index, cache, 1 / (1 + np.exp(-logits)) - y)

    def loss():
        z = toxicity.forward(m, x, index)
        return (np.log1p(np.exp(z)) - y * z).sum()

    def slope(a, i):
        kept = a[i]
        a[i] = kept + 1e-6
        up = loss()
        a[i] = kept - 1e-6
        down = loss()
        a[i] = kept
        return (up - down) / 2e-6
    for k in ("Wf", "Wb", "Uf", "Ub", "Bf", "A", "a", "q", "v", "c"):
        i = tuple(rng.integers(s) for s in m[k].shape)
        assert math.isclose(slope(m[k], i), grads[k][i], rel_tol=1e-3, abs_tol=1e-7), k
    assert math.isclose(slope(x, (2, 3)), dx[2, 3], rel_tol=1e-3, abs_tol=1e-7)


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        index, _ = toxicity.windows(np.arange(n), np.zeros(n, int), 1, n)
        assert set(range(n)) <= set(index.ravel().tolist()) and (n == 0 or index.min() == 0)


def test_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    labels = load(spark, base, "labels")
    docs = load(spark, base, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    for run, column, cut in ((toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)):
        rows = run(docs, labels).join(labels, "doc_id").where(toxicity.held_out()).collect()
        of = lambda v: [r.score >= cut for r in rows if r[column] == v]
        assert np.mean(of(1)) > 0.85 and np.mean(of(0)) < (0.05 if column == "toxic" else 0.25), column
