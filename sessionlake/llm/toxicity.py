"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Words are runs of letters and digits. The input of a word is a vector of its
own (hashed into buckets) and the mean of vectors of its character n-grams,
with marks at both ends, so that unseen words are read by their characters.
Two gated recurrent layers run over a window of ``WINDOW`` words, one in each
direction; attention pools their states; a logistic unit scores the window. All
windows of a text are scored, each overlapping the one before by a quarter, and the
text has the score of its worst window.

The network is trained in numpy on the driver, from at most ``SAMPLE`` labelled
documents (first by digest of the id, a third of them toxic ones; of each
at most ``SAMPLE_WINDOWS`` windows in a step, drawn at random). This bound
concerns fitting only: every window of every text is scored.

Defined results: null or empty texts, and texts without any word, are one empty
window. Repeated rows are scored each. Labels of unknown documents are ignored;
a document with several labels is toxic if one says so. Without any toxic
label all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernel
from .common import load, null_ids, plain_ids, texts

WINDOW, STEP = 32, 24
SAMPLE, SAMPLE_WINDOWS = 3000, 8
WORD_BUCKETS, WORD_DIM = 1 << 14, 8
GRAM_BUCKETS, GRAM_DIM = 1 << 15, 12
GRAMS = (3, 4, 5)
HIDDEN, ATTENTION = 8, 8
STEPS, BATCH, RATE = 480, 64, 0.01
f32 = np.float32


def words(chunk: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The different words of a chunk with their buckets and n-grams, and the
    sequence of words of each text."""
    chunk = kernel.LOWER[chunk]
    starts, stops = kernel.runs(chunk, kernel.ALNUM)
    hashes = kernel.hashes(chunk, starts, stops)
    _, at, sequence = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[at], stops[at]
    padded = chunk.copy()
    padded[~kernel.ALNUM[chunk]] = 1  # the mark at both ends of a word
    padded = np.concatenate([[np.uint8(1)], padded, [np.uint8(1)]])
    length = e - s + 2  # with both marks; the word begins at s in padded
    many = [np.maximum(length - n + 1, 0) for n in GRAMS]
    first_gram = np.concatenate([[0], np.cumsum(sum(many))])
    grams, filled = np.empty(first_gram[-1], np.int32), first_gram[:-1].copy()
    for n, m in zip(GRAMS, many):
        own = np.repeat(np.arange(len(s)), m)
        k = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
        code = np.full(len(own), n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                code = code * np.uint64(1000003) + padded[s[own] + k + j]
        grams[filled[own] + k] = (kernel.mixed(code) % np.uint64(GRAM_BUCKETS)).astype(np.int32)
        filled += m
    return {"word": (hashes[at] % np.uint64(WORD_BUCKETS)).astype(np.int32), "gram": grams, "first": first_gram,
            "sequence": sequence, "text": kernel.owners(ends, starts)}


def some_words(w: dict, which: np.ndarray) -> dict:
    """The entries of ``words`` for some of the words."""
    many = (w["first"][1:] - w["first"][:-1])[which]
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(w["first"][which] - first[:-1], many) + np.arange(first[-1])
    return {"word": w["word"][which], "gram": w["gram"][at], "first": first}


def windows(sequence: np.ndarray, text: np.ndarray, n_texts: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) matrix of words, padded with ``n_words``, and each window's text."""
    count = np.bincount(text, minlength=n_texts)
    first = np.cumsum(count) - count
    many = np.maximum(1, -(-(count - (WINDOW - STEP)) // STEP))
    owner = np.repeat(np.arange(n_texts), many)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < count[owner][:, None]
    at = np.where(inside, place + first[owner][:, None], 0)
    padded = np.append(sequence, n_words) if len(sequence) == 0 else sequence
    return np.where(inside, padded[at], n_words), owner


def _sigmoid(x):
    return f32(0.5) * (np.tanh(x * f32(0.5)) + f32(1))


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_DIM + GRAM_DIM
    m = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "gram": rng.normal(0, 0.3, (GRAM_BUCKETS, GRAM_DIM)),
         "A": rng.normal(0, 0.3, (2 * HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "q": rng.normal(0, 0.3, ATTENTION),
         "v": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
    for d in ("f", "b"):
        m |= {f"W{d}": rng.normal(0, size**-0.5, (size, 3 * HIDDEN)), f"B{d}": np.zeros(3 * HIDDEN),
              f"U{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))}
    return {k: v.astype(f32) for k, v in m.items()}


def _root(w: dict) -> np.ndarray:
    return np.sqrt(np.maximum(np.diff(w["first"]), 1)).astype(f32)


def inputs(m: dict, w: dict, keep: np.ndarray | None = None) -> np.ndarray:
    """The input vectors of the different words, (words, word and gram parts)."""
    grams = np.zeros((len(w["word"]), GRAM_DIM), f32)
    if len(grams):  # every word has n-grams, with its marks
        grams[:] = np.add.reduceat(m["gram"][w["gram"]], w["first"][:-1], axis=0)
    grams /= _root(w)[:, None]
    own = m["word"][w["word"]]
    return np.hstack([own if keep is None else own * keep[:, None], grams])


def forward(m: dict, x: np.ndarray, index: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """Logits of windows; ``index`` has the rows of ``x``, len(x) where padded."""
    n, H = len(index), HIDDEN
    real = index < len(x)
    states = np.zeros((WINDOW, n, 2 * H), f32)
    for d, places in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        projected = np.vstack([x @ m[f"W{d}"] + m[f"B{d}"], np.zeros((1, 3 * H), f32)])
        U, h, at = m[f"U{d}"], np.zeros((n, H), f32), slice(0, H) if d == "f" else slice(H, 2 * H)
        for t in places:
            p, r = projected[index[:, t]], h @ U
            gates = _sigmoid(p[:, :2 * H] + r[:, :2 * H])
            z, g = gates[:, :H], gates[:, H:]
            new = np.tanh(p[:, 2 * H:] + g * r[:, 2 * H:])
            keep = real[:, t, None]
            if cache is not None:
                cache[d, t] = (h, z, g, new, r[:, 2 * H:])
            h = np.where(keep, new + z * (h - new), h)
            states[t, :, at] = h
    u = np.tanh(states @ m["A"] + m["a"])
    e = np.where(real.T, u @ m["q"], f32(-1e9))
    e = np.exp(e - e.max(axis=0))
    attention = e * real.T
    attention /= np.maximum(attention.sum(axis=0), f32(1e-9))
    pooled = np.einsum("tn,tnh->nh", attention, states)
    if cache is not None:
        cache |= {"states": states, "u": u, "attention": attention, "pooled": pooled, "real": real}
    return pooled @ m["v"] + m["c"][0]


def backward(m: dict, x: np.ndarray, index: np.ndarray, cache: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters but the tables, and of ``x``."""
    H, g_ = HIDDEN, {}
    states, u, att, real = cache["states"], cache["u"], cache["attention"], cache["real"]
    g_["v"], g_["c"] = cache["pooled"].T @ dlogit, np.array([dlogit.sum()], f32)
    dpooled = dlogit[:, None] * m["v"]
    dstates = att[:, :, None] * dpooled
    datt = np.einsum("nh,tnh->tn", dpooled, states)
    de = att * (datt - (att * datt).sum(axis=0))
    g_["q"] = np.einsum("tn,tna->a", de, u)
    du = de[:, :, None] * m["q"] * (1 - u * u)
    g_["A"], g_["a"] = np.einsum("tnh,tna->ha", states, du), du.sum(axis=(0, 1))
    dstates += du @ m["A"].T
    dx = np.zeros_like(x)
    for d, places in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
        U, dh, dU = m[f"U{d}"], np.zeros((len(index), H), f32), np.zeros_like(m[f"U{d}"])
        dproj = np.zeros((len(x) + 1, 3 * H), f32)
        at = slice(0, H) if d == "f" else slice(H, 2 * H)
        for t in places:
            h, z, g, new, r = cache[d, t]
            dh = dh + dstates[t, :, at]
            own = np.where(real[:, t, None], dh, f32(0))
            dnew = own * (1 - z) * (1 - new * new)
            dz = own * (h - new) * z * (1 - z)
            dg = dnew * r * g * (1 - g)
            through = np.hstack([dz, dg, dnew * g])
            dU += h.T @ through
            np.add.at(dproj, index[:, t], np.hstack([dz, dg, dnew]))
            dh = np.where(real[:, t, None], dh * z, dh) + through @ U.T
        g_[f"U{d}"], g_[f"W{d}"], g_[f"B{d}"] = dU, x.T @ dproj[:-1], dproj[:-1].sum(axis=0)
        dx += dproj[:-1] @ m[f"W{d}"].T
    return g_, dx


def train(sample: list[str], toxic: np.ndarray, seed: int = 11, steps: int = STEPS) -> dict:
    """Fits the network: a text is as toxic as its worst window."""
    rng = np.random.default_rng(seed)
    m = initial(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    weight = np.where(toxic > 0, 0.3 / max(1, toxic.sum()), 0.7 / max(1, (1 - toxic).sum())) * len(toxic)
    step = 0
    _, chunk, ends = next(kernel.chunks(sample, 1 << 60))
    every = words(chunk, ends)
    all_windows, whose = windows(every["sequence"], every["text"], len(sample), len(every["word"]))
    per_text = np.bincount(whose, minlength=len(sample))
    begin = np.cumsum(per_text) - per_text
    while step < steps:
        order = rng.permutation(len(sample))
        for b in range(0, len(order), BATCH):
            chosen = order[b:b + BATCH]
            drawn = [begin[k] + (rng.permutation(per_text[k])[:SAMPLE_WINDOWS] if per_text[k] > SAMPLE_WINDOWS else np.arange(per_text[k])) for k in chosen]
            owner = np.repeat(np.arange(len(chosen)), [len(d) for d in drawn])
            index = all_windows[np.concatenate(drawn)]
            present = np.unique(index)
            index = np.searchsorted(present, index)
            present = present[present < len(every["word"])]  # what is padded comes last
            w = some_words(every, present)
            keep = (rng.random(len(present)) < 0.5).astype(f32) * 2  # words are dropped, so that characters are learned
            x = inputs(m, w, keep)
            logits = forward(m, x, index)
            worst = np.lexsort((-logits, owner))
            worst = worst[np.unique(owner[worst], return_index=True)[1]]
            index = index[worst]
            cache: dict = {}
            logits = forward(m, x, index, cache)
            dlogit = ((_sigmoid(logits) - toxic[chosen]) * weight[chosen] / len(chosen)).astype(f32)
            grads, dx = backward(m, x, index, cache, dlogit)
            grads["word"], grads["gram"] = np.zeros_like(m["word"]), np.zeros_like(m["gram"])
            np.add.at(grads["word"], w["word"], dx[:, :WORD_DIM] * keep[:, None])
            np.add.at(grads["gram"], w["gram"], np.repeat(dx[:, WORD_DIM:] / _root(w)[:, None], np.diff(w["first"]), axis=0))
            step += 1
            rate = RATE * max(0.0, 1 - step / steps) + 1e-4
            for k in m:
                first[k] += f32(0.1) * (grads[k] - first[k])
                second[k] += f32(0.01) * (grads[k] ** 2 - second[k])
                scale = f32(rate / (1 - 0.9**step))
                m[k] -= scale * first[k] / (np.sqrt(second[k] / f32(1 - 0.99**step)) + f32(1e-6))
    return m


def scored(m: dict, batch: list[str]) -> np.ndarray:
    """The score of each text: that of its worst window."""
    out = np.zeros(len(batch))
    for first, chunk, ends in kernel.chunks(batch, 1_000_000):
        w = words(chunk, ends)
        index, owner = windows(w["sequence"], w["text"], len(ends), len(w["word"]))
        x = inputs(m, w)
        logits = np.concatenate([forward(m, x, index[k:k + 4096]) for k in range(0, len(index), 4096)])
        worst = np.full(len(ends), -np.inf)
        np.maximum.at(worst, owner, logits)
        out[first:first + len(ends)] = 1 / (1 + np.exp(-worst.astype(float)))
    return out


def held_out(fold: int = 5):
    """Documents whose labels are not learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Trains on at most ``sample`` labelled documents that are not held out."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.md5(F.col("doc_id").cast("string"))
    some = marks.where("toxic = 1").orderBy(order, "doc_id").limit(sample // 3).unionByName(
        marks.where("toxic = 0").orderBy(order, "doc_id").limit(sample - sample // 3))
    rows = texts(docs).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    toxic = np.array([r.toxic for r in rows], float)
    if not toxic.any() or toxic.all():
        return None
    return train([r.text for r in rows], toxic)


def _score_column(frame: DataFrame, m: dict | None, text_col: str) -> DataFrame:
    """All columns of ``frame`` and last ``score``; ``text_col`` is read."""
    model = frame.sparkSession.sparkContext.broadcast(m)  # about 2 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = ["" if t is None else t for t in b[text_col].tolist()]
            b["score"] = np.zeros(len(raw)) if model.value is None else scored(model.value, raw)
            yield b

    return frame.mapInPandas(run, StructType([*frame.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    rows = texts(docs, id_col, text_col)
    return null_ids(_score_column(plain_ids(rows), fit(rows, labels), "text").select("doc_id", "score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns; learns
    from the labelled ones among them."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))
    return _score_column(packed, fit(docs, labels), "text").where(F.col("score") < threshold).select("doc.*")


def op6_toxicity(spark, sf_dir):
    found = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
