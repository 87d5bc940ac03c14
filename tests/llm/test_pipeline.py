"""Every stage of the pipeline next to brute force on what the one before kept."""

import re

import numpy as np

import brute
import corpus_pipeline
from sessionlake.llm import bpe, mixing, toxicity
from sessionlake.llm.common import load, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]

    clean = stored(stage["toxicity"](spark, docs, SF), "t")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, load(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5} and clean.columns == docs.columns

    single = stored(stage["exact dedup"](spark, clean, SF), "t")
    best = {}
    for r in clean.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in single.collect()} == {i for _, i in best.values()} and single.columns == docs.columns

    apart = stored(stage["near dedup"](spark, single, SF), "t")
    classes = brute.near_classes([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id for r in apart.collect()} == set(classes.values()) and apart.columns == docs.columns

    mixed = stored(stage["mixing"](spark, apart, SF), "t")
    words = lambda rows: {s: sum(len(brute.WORD.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}}
    have, taken = words(apart.collect()), words(mixed.collect())
    largest = max(len(brute.WORD.findall(r.text)) for r in apart.collect())
    for r in mixing.source_targets(mixing.sizes(apart)).collect():
        assert abs(taken.get(r.source, 0) - r.target) <= 2 * largest and taken.get(r.source, 0) <= 3 * have[r.source]
    assert mixed.columns == docs.columns

    done = stage["byte-level BPE"](spark, mixed, SF).collect()
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    texts = {r.doc_id: r.text for r in apart.collect()}
    assert len(done) == mixed.count()
    for r in done:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4
