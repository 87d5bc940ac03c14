"""Quality classifier: random-indexing word vectors and a small network.

Tokens are runs of letters and digits, runs of other signs, and the shape of
each run (its kind, case and length). A token has a fixed sparse random index
vector; its word vector is the sum of the index vectors of the tokens around it
in the whole table, besides its own. Word vectors are kept for hash buckets, so
their table has a fixed size; tasks add up their part of it, and parts are
added by a shuffle. A document is the mean of its word vectors. A network of
two layers, trained in numpy on at most ``SAMPLE`` labelled documents, gives a
logit, and a temperature fitted on documents not trained on calibrates it.

Defined results: null or empty texts are the zero vector. Repeated rows are
scored each. Of several labels of a document the least counts. Without labels
of both kinds every score is the share of label 1, or 0.5 if there is no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import load, null_ids, plain_ids, texts
from .toxicity import held_out

BUCKETS, DIM, BLOCK, SPARSE = 1 << 14, 48, 1024, 4
AROUND = 2
SAMPLE, HIDDEN, EPOCHS = 12_000, 24, 60
U64 = np.uint64
f32 = np.float32

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 other signs, 2 letters and digits
_KIND[:] = 1
_KIND[kernel.ALNUM] = 2
_KIND[~kernel.NOT_WHITE] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def index_vectors() -> np.ndarray:
    """The fixed random vectors of all buckets: a few entries of 1 or -1 each."""
    rng = np.random.default_rng(5)
    out = np.zeros((BUCKETS, DIM), f32)
    for _ in range(SPARSE):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice([-1, 1], BUCKETS)
    return out


def tokens(chunk: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all tokens of a chunk, the shape after its run."""
    kind = np.concatenate([[0], _KIND[chunk], [0]])
    turn = np.flatnonzero(kind[1:] != kind[:-1])
    starts, stops = turn[:-1], turn[1:]
    real = kind[1:][starts] > 0
    starts, stops = starts[real], stops[real]
    own = kernel.hashes(chunk, starts, stops) % U64(BUCKETS)
    upper = np.concatenate([[0], np.cumsum(_UPPER[chunk])])
    ups, length = upper[stops] - upper[starts], stops - starts
    case = np.where(ups == 0, 0, np.where(ups == length, 1, 2))
    glued = np.concatenate([[False], starts[1:] == stops[:-1]])
    shape = ((kind[1:][starts].astype(np.int64) * 3 + case) * 2 + glued) * 8 + np.minimum(length, 7)
    out = np.empty(2 * len(own), np.int64)
    out[0::2] = own
    out[1::2] = (kernel.mixed(shape.astype(np.uint64) + U64(77)) % U64(BUCKETS)).astype(np.int64)
    return out, np.repeat(kernel.owners(ends, starts), 2)


def contexts(chunk_tokens: np.ndarray, text: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` the index vectors around every token."""
    if not len(chunk_tokens):
        return
    # Tokens in a row with empty places between texts; sums of neighbours are
    # sums of shifted rows. Index vectors are whole numbers of at most SPARSE.
    turn = np.concatenate([[0], np.cumsum(text[1:] != text[:-1])])
    place = np.arange(len(text)) + AROUND * (turn + 1)
    padded = np.full(place[-1] + AROUND + 1, BUCKETS)
    padded[place] = chunk_tokens
    rows = np.vstack([index, np.zeros((1, DIM))]).astype(np.int8)[padded]
    n = len(rows) - 2 * AROUND
    near = np.zeros((n, DIM), np.int8)
    for k in (*range(-AROUND, 0), *range(1, AROUND + 1)):
        near += rows[AROUND + k:AROUND + k + n]
    del rows, padded
    order = np.argsort(chunk_tokens.astype(np.uint16), kind="stable")
    bucket = chunk_tokens[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    total[bucket[first]] += np.add.reduceat(near[place[order] - AROUND].astype(f32), first, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vectors of all buckets, from every text of ``docs``; unit length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIM), f32)
        for b in batches:
            for _, chunk, ends in kernel.chunks(b.text.tolist(), 200_000):
                contexts(*tokens(chunk, ends), index, total)
        if total.any():
            blocks = range(0, BUCKETS, BLOCK)
            yield pd.DataFrame({"block": [k // BLOCK for k in blocks], "part": [total[k:k + BLOCK].tobytes() for k in blocks]})

    def add(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK * DIM)
        for frame in frames:
            for part in frame.part:
                total += np.frombuffer(part, f32)
        yield pd.DataFrame({"block": [key[0]], "part": [total.astype(f32).tobytes()]})

    # Parts of a block are added in two rounds, so that no task reads those of all tasks.
    parts = docs.mapInPandas(run, "block long, part binary").withColumn("some", F.spark_partition_id() % 32)

    schema = "block long, part binary"
    found = parts.groupBy("block", "some").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
    table = index_vectors()
    for r in found:
        table[r.block * BLOCK:(r.block + 1) * BLOCK] += np.frombuffer(r.part, f32).reshape(BLOCK, DIM)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), f32(1e-9))


def pooled(table: np.ndarray, batch: list[str]) -> np.ndarray:
    """The mean word vector of each text."""
    out = np.zeros((len(batch), DIM), f32)
    for first, chunk, ends in kernel.chunks(batch, 100_000):
        token, text = tokens(chunk, ends)
        if len(token):
            at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            sums = np.add.reduceat(table[token], at, axis=0)
            out[first + text[at]] = sums / np.diff(np.append(at, len(token)))[:, None].astype(f32)
    return out


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> dict:
    """Two layers, then the temperature that suits the tenth left aside."""
    rng = np.random.default_rng(seed)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - center) / scale
    aside = rng.random(len(x)) < 0.1
    if len(set(y[~aside])) < 2 or not aside.any():
        aside[:] = False
    tx, ty = x[~aside], y[~aside]
    w = {"W": rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(1)}
    first, second, step = {k: 0 * v for k, v in w.items()}, {k: 0 * v for k, v in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(tx))
        for k in range(0, len(order), 128):
            at = order[k:k + 128]
            h = np.tanh(tx[at] @ w["W"] + w["b"])
            d = (1 / (1 + np.exp(-(h @ w["v"] + w["c"]))) - ty[at]) / len(at)
            dh = d[:, None] * w["v"] * (1 - h * h)
            g = {"W": tx[at].T @ dh + 1e-4 * w["W"], "b": dh.sum(axis=0), "v": h.T @ d + 1e-4 * w["v"], "c": d.sum(keepdims=True)}
            step += 1
            for n in w:
                first[n] += 0.1 * (g[n] - first[n])
                second[n] += 0.01 * (g[n] ** 2 - second[n])
                w[n] = w[n] - 0.003 / (1 - 0.9**step) * first[n] / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    w |= {"center": center, "scale": scale, "temperature": 1.0}
    if aside.any():
        z, t = logits(w, x[aside] * scale + center), y[aside]
        loss = lambda s: np.logaddexp(0, np.where(t > 0, -z, z) / s).mean()
        w["temperature"] = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return w


def logits(w: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh((x - w["center"]) / w["scale"] @ w["W"] + w["b"]) @ w["v"] + w["c"]


def probabilities(w: dict, x: np.ndarray) -> np.ndarray:
    if "share" in w:
        return np.full(len(x), w["share"])
    return 1 / (1 + np.exp(-logits(w, x) / w["temperature"]))


def fit(docs: DataFrame, labels: DataFrame, table, sample: int = SAMPLE) -> dict:
    """Trains on at most ``sample`` labelled documents that are not held out (the first by digest of the id)."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    some = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "quality": b.quality, "x": list(pooled(table.value, b.text.tolist()))})

    rows = docs.join(F.broadcast(some), "doc_id").mapInPandas(run, "doc_id long, quality int, x array<float>")
    found = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    y = found.quality.to_numpy(float)
    if len(set(y)) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    return train(np.stack(found.x.to_list()).astype(float), y)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    rows = texts(docs, id_col, text_col)
    table = rows.sparkSession.sparkContext.broadcast(word_vectors(rows))  # 3 MB
    model = fit(rows, labels, table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "score": probabilities(model, pooled(table.value, b.text.tolist()).astype(float))})

    return null_ids(plain_ids(rows).mapInPandas(run, "doc_id long, score double"))


def op3_quality(spark, sf_dir):
    found = quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
