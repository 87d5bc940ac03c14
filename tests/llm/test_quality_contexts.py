"""Sums of neighbours' index vectors, next to a plain loop."""

import tracemalloc

import numpy as np

from sessionlake.llm import quality


def test_contexts_are_sums_of_neighbours_within_a_text():
    rng = np.random.default_rng(4)
    index = quality.index_vectors()
    token = rng.integers(0, 40, 600)
    text = np.sort(rng.choice([0, 1, 2, 5, 6, 9], 600))
    text[-1] = 11
    want = np.zeros_like(index)
    for i in range(600):
        for j in range(max(0, i - quality.AROUND), min(600, i + quality.AROUND + 1)):
            if j != i and text[j] == text[i]:
                want[token[i]] += index[token[j]]
    got = np.zeros_like(index)
    quality.contexts(token, text, index, got)
    assert np.array_equal(got, want)


def test_neighbours_are_not_fetched_one_by_one():
    n = 400_000
    token, text = np.arange(n) % quality.BUCKETS, np.zeros(n, np.int64)
    index, total = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIM), np.float32)
    tracemalloc.start()
    quality.contexts(token, text, index, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * n  # bytes; rows of floats for every neighbour took 440
