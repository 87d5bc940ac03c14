"""Language-model scoring with Brown class-based bigrams.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Every word of the training texts has a class of its own, learned from its
contexts. Clustering has two parts. First, in ``ROUNDS`` rounds, the driver
exchanges the ``HEAD`` most frequent words one by one, next to ``SHAPES`` units of
all other words by ending and length; each round is a pass in which tasks add up
how often each unit follows and precedes each class (tables of a fixed size). Then,
in ``TAIL_ROUNDS`` rounds, each other word seen in training, the tail, leaves
its shape: the counts of classes before and after it are shuffled by word, and
each word moves to the class with the best likelihood. Tail words of a round move
together, by the class bigrams before the round.

The class of a shape unit remains for words unseen in training. They share what
absolute discounting takes off the tail words of their shape.

Classes and counts of at most ``KNOWN`` of the most frequent words are broadcast
(4 MB); other words of a text, and so the pairs they are in, are joined with
the table of tail words.

Defined results: null texts are empty, and an empty text is its end alone. Rows
that repeat are scored (and learned) each. Without training texts every word is
unseen. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import load, null_ids, plain_ids, stored, texts

HEAD, SHAPES, KNOWN = 8192, 512, 262_144
CLASSES, ROUNDS, TAIL_ROUNDS = 48, 8, 2
DISCOUNT, PRIOR = 0.75, 2.0
FOLDS, HELD = 7, 2
BLOCK = 512
#: Training tokens for each bucket of tail words, and entries whose gains are computed at once.
BUCKET, AT_ONCE = 4_000_000, 50_000
U64 = np.uint64
#: Stands for the end of a text among the hashes of words; its unit is 0.
END = kernel.mixed(np.array([0xE0D], np.uint64))[0]
UNITS = 1 + HEAD + SHAPES


def tokens(chunk: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape unit, tokens per text) of a chunk, an end after each text."""
    chunk = kernel.LOWER[chunk]
    starts, stops = kernel.runs(chunk, kernel.NOT_WHITE)
    word = kernel.hashes(chunk, starts, stops)
    last, length = chunk[stops - 1].astype(np.uint64), stops - starts
    before = np.where(length > 1, chunk[np.maximum(stops - 2, 0)], 0).astype(np.uint64)
    shape = kernel.mixed((last << U64(16)) + (before << U64(8)) + np.minimum(length, 9).astype(np.uint64)) % U64(SHAPES)
    at = np.searchsorted(starts, ends)  # the words up to the end of each text
    count = np.diff(np.concatenate([[0], at])) + 1
    return np.insert(word, at, END), np.insert(shape.astype(np.int64) + 1 + HEAD, at, 0), count


def word_counts(training: DataFrame) -> DataFrame:
    """(word, unit, n) of all tokens of the training texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, chunk, ends in kernel.chunks(b.text.tolist(), 8_000_000):
                word, unit, _ = tokens(chunk, ends)
                found, at, n = np.unique(word, return_index=True, return_counts=True)
                yield pd.DataFrame({"word": found.view(np.int64), "unit": unit[at], "n": n})

    rows = training.select("text").mapInPandas(run, "word long, unit long, n long")
    return stored(rows.groupBy("word").agg(F.max("unit").alias("unit"), F.sum("n").alias("n")), "words")


def frequent(words: DataFrame, most: int = KNOWN) -> DataFrame:
    """The words whose count is so high that at most ``most`` words have it or a
    higher one.  The bound is found on a histogram of counts, so that no task
    sends its own first ``most`` words to the driver."""
    fewer = Window.orderBy(F.col("n").desc())
    sizes = words.where("unit > 0").groupBy("n").agg(F.count("*").alias("k"))
    least = sizes.select("n", F.sum("k").over(fewer).alias("k")).where(F.col("k") <= most).agg(F.min("n")).first()[0]
    return words.where("unit > 0").where(F.lit(False) if least is None else F.col("n") >= least)


def sequences(docs: DataFrame, model: Any) -> DataFrame:
    """Per text: what the broadcast words give, the places of its words in the
    broadcast list (0 is the end; minus the shape unit, when not there), and the words that are not there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            for first, chunk, ends in kernel.chunks(b.text.tolist()):
                word, unit, count = tokens(chunk, ends)
                at = np.minimum(np.searchsorted(m["words"], word), len(m["words"]) - 1)
                there = m["words"][at] == word
                place = np.where(there, m["places"][at], -unit).astype("<i4")
                n = np.where(there, m["counts"][np.maximum(place, 0)], 0)
                owner = np.repeat(np.arange(len(count)), count)
                base = np.where(there, np.log10((n + 1) / (m["tokens"] + m["different"] + 1)), 0.0)
                cut = np.cumsum(count)[:-1]
                rest = np.flatnonzero(~there)
                part = b.iloc[first:first + len(count)]
                yield pd.DataFrame({
                    "doc_id": part.doc_id, "held_out": part.held_out, "n_tokens": count,
                    "n_known": np.bincount(owner, weights=n > 0, minlength=len(count)).astype(np.int64),
                    "base": np.bincount(owner, weights=base, minlength=len(count)),
                    "places": [x.tobytes() for x in np.split(place, cut)],
                    "far": [x.tobytes() for x in np.split(word[rest], np.searchsorted(rest, cut))]})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, places binary, far binary"
    return stored(plain_ids(docs).mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "units")


def neighbours(training: DataFrame, classes: np.ndarray, model: Any) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit is before and after a word of each class, (units, classes) each."""
    shared = training.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, units, total = shared.value, model.value["units"], np.zeros((2, UNITS * CLASSES), np.int64)
        for b in batches:
            place = np.frombuffer(b"".join(b.places), "<i4")
            unit = np.where(place < 0, -place, units[np.maximum(place, 0)]).astype(np.int64)
            if len(unit):
                total[0] += np.bincount(unit * CLASSES + of[np.append(unit[1:], 0)], minlength=UNITS * CLASSES)
                total[0, unit[-1] * CLASSES + of[0]] -= 1  # the batch's last end is followed by nothing
                total[1] += np.bincount(unit * CLASSES + of[np.concatenate([[0], unit[:-1]])], minlength=UNITS * CLASSES)
        if total.any():
            cut = range(0, UNITS, BLOCK)
            parts = [total.reshape(2, UNITS, CLASSES)[:, k:k + BLOCK].tobytes() for k in cut]
            yield pd.DataFrame({"block": [k // BLOCK for k in cut], "part": parts})

    def add(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Any = 0
        for frame in frames:
            for part in frame.part:
                total = total + np.frombuffer(part, np.int64)
        yield pd.DataFrame({"block": [key[0]], "part": [total.tobytes()]})

    schema = "block long, part binary"
    parts = training.select("places").mapInPandas(run, schema).withColumn("some", F.spark_partition_id() % 64)
    found = parts.groupBy("block", "some").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
    total = np.zeros((2, UNITS, CLASSES))
    for r in found:
        part = total[:, r.block * BLOCK:(r.block + 1) * BLOCK]
        part[:] = np.frombuffer(r.part, np.int64).reshape(part.shape)
    return total[0], total[1]


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over, as it does when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def table_of(classes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Class bigram counts."""
    out = np.zeros((CLASSES, CLASSES))
    np.add.at(out, classes, after)
    return out


def likelihood(table: np.ndarray) -> float:
    return _xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum()


def exchange(classes: np.ndarray, after: np.ndarray, before: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Moves units one by one to the class with the best likelihood of the class bigrams."""
    classes = classes.copy()
    table = np.maximum(table_of(classes, after), 0.0)
    size, n = table.sum(axis=1), after.sum(axis=1)
    for u in movable:
        a, out, into = classes[u], after[u], before[u]
        table[a] -= out
        table[:, a] -= into
        np.maximum(table, 0.0, out=table)
        size[a] = max(0.0, size[a] - n[u])
        f = _xlogx(table)
        gain = (_xlogx(table + out).sum(axis=1) - f.sum(axis=1) + _xlogx(table + into[:, None]).sum(axis=0) - f.sum(axis=0)
                - 2 * (_xlogx(size + n[u]) - _xlogx(size)))
        b = int(np.argmax(gain))
        classes[u] = b
        table[b] += out
        table[:, b] += into
        size[b] += n[u]
    return classes


def clustered(training: DataFrame, model: Any, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, class bigrams, unit counts) of the best round. The end keeps class 0 for itself."""
    rng = np.random.default_rng(1)
    classes = np.arange(UNITS) % (CLASSES - 1) + 1
    classes[0] = 0
    best = None
    for k in range(rounds + 1):
        released(training.sparkSession)
        after, before = neighbours(training, classes, model)
        table = table_of(classes, after)
        if best is None or likelihood(table) > best[0]:
            best = likelihood(table), classes, table, before.sum(axis=1)
        if k < rounds:
            seen = np.flatnonzero(before.sum(axis=1)[1:] > 0) + 1
            movable = seen if k == 0 else seen[rng.random(len(seen)) < 0.5]
            order = movable[np.argsort(-before[movable].sum(axis=1), kind="stable")]
            classes = exchange(classes, after, before, order)
    return best[1:]


def counted(word: np.ndarray, slot: np.ndarray, now: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(word, slot, class now, n), each word and slot once."""
    key = kernel.mixed(word + slot.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    at = order[first]
    k = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order].astype(np.int64), first) if len(n) else n
    return word[at], slot[at], now[at], k


def pieces(batches: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Whole texts of about ``most`` words, or one longer text."""
    for b in batches:
        part = b.places.map(len).cumsum() // (4 * most)
        for _, piece in b.groupby(part.to_numpy()):
            yield piece.reset_index(drop=True)


def bucketed(word: np.ndarray, slot: np.ndarray, now: np.ndarray, buckets: int) -> pd.DataFrame:
    """Entries of tail words in a row for each bucket."""
    word, slot, now, n = counted(word, slot, now)
    bucket = (word % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    cut = lambda x, kind: [y.tobytes() for y in np.split(x[order].astype(kind), first[1:])]
    return pd.DataFrame({"bucket": found, "word": cut(word, "<u8"), "slot": cut(slot, "u1"), "now": cut(now, "u1"), "n": cut(n, "<u4")}) if len(found) else \
        pd.DataFrame({"bucket": np.zeros(0, np.int64), "word": [], "slot": [], "now": [], "n": []})


def best_classes(owner: np.ndarray, slot: np.ndarray, n: np.ndarray, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word with the best likelihood, the word taken out of its
    class. ``owner`` (sorted) is the word of an entry, ``slot`` the class before
    it, or CLASSES and more for the class after it; ``now`` goes by word. Entries
    that meet in one cell of the table count one by one."""
    size, f = table.sum(axis=1), _xlogx(table)
    # By slot, then by the class that the word would be in.
    there, level = np.concatenate([table, table.T]), np.concatenate([f, f.T])
    total = np.bincount(owner, weights=np.where(slot < CLASSES, n, 0), minlength=len(now))
    out = np.empty(len(now), np.int64)
    starts = np.searchsorted(owner, np.arange(len(now) + 1))
    first = 0
    while first < len(now):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + AT_ONCE, side="right")) - 1)
        part, words = slice(starts[first], starts[last]), np.arange(last - first)
        s, k, who = slot[part], n[part].astype(float), owner[part] - first
        gain = _xlogx(there[s] + k[:, None]) - level[s]
        own = now[first:last][who]
        at = np.arange(len(s))
        gain[at, own] = level[s, own] - _xlogx(np.maximum(there[s, own] - k, 0.0))
        gain = np.add.reduceat(gain, starts[first:last] - starts[first], axis=0)
        t = total[first:last]
        less = _xlogx(size + t[:, None]) - _xlogx(size)
        own = now[first:last]
        less[words, own] = _xlogx(size[own]) - _xlogx(np.maximum(size[own] - t, 0.0))
        gain -= 2 * less
        gain[:, 0] = -np.inf  # the end keeps its class for itself
        out[first:last] = gain.argmax(axis=1)
        first = last
    return out


def moved(entries: DataFrame, table: np.ndarray, model: Any) -> DataFrame:
    """(word, c, n, place) of all tail words: the class after the move, tokens in training, place in the broadcast list or -1."""
    shared = entries.sparkSession.sparkContext.broadcast(table)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        m = model.value
        joined = lambda k, kind: np.frombuffer(b"".join(b[k]), kind)
        word, slot, now, n = counted(joined("word", "<u8"), joined("slot", "u1"), joined("now", "u1"), joined("n", "<u4"))
        order = np.argsort(word, kind="stable")
        word, slot, now, n = word[order], slot[order].astype(np.int64), now[order].astype(np.int64), n[order]
        found, first, owner = np.unique(word, return_index=True, return_inverse=True)
        c = best_classes(owner, slot, n, now[first], shared.value)
        at = np.minimum(np.searchsorted(m["words"], found), len(m["words"]) - 1)
        return pd.DataFrame({"word": found.view(np.int64), "c": c, "n": np.bincount(owner, weights=np.where(slot < CLASSES, n, 0)).astype(np.int64),
                             "place": np.where(m["words"][at] == found, m["places"][at], -1)})

    return stored(entries.groupBy("bucket").applyInPandas(run, "word long, c long, n long, place long"), "tail")


def near_entries(training: DataFrame, known: np.ndarray, shapes: np.ndarray | None, model: Any, buckets: int) -> DataFrame:
    """Entries of tail words by the classes of broadcast words, and of shapes for all others if given."""
    shared = training.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, m = shared.value, model.value
        for b in pieces(batches):
            place = np.frombuffer(b"".join(b.places), "<i4").astype(np.int64)
            if not len(place):
                continue
            word = m["hashes"][np.maximum(place, 0)]
            word[place < 0] = np.frombuffer(b"".join(b.far), "<u8")
            c = of[np.maximum(place, 0)]
            if shapes is not None:
                c = np.where(place < 0, shapes[np.maximum(-place, 0)], c)
            tail, here = (place < 0) | (place > HEAD), (place >= 0) | (shapes is not None)
            # Before the first text of a batch, and after the last, is an end.
            prev, next_ = np.concatenate([[0], np.arange(len(place) - 1)]), np.append(np.arange(1, len(place)), 0)
            before, after, led = c[prev], c[next_], here[prev]
            before[0], led[0] = of[0], True
            x, y = tail & here & led, tail & here & here[next_]
            yield bucketed(np.concatenate([word[x], word[y]]), np.concatenate([before[x], after[y] + CLASSES]), np.concatenate([c[x], c[y]]), buckets)

    return training.select("places", "far").mapInPandas(run, "bucket long, word binary, slot binary, now binary, n binary")


def linked(placed: DataFrame, tail: DataFrame, known: np.ndarray, shapes: np.ndarray) -> DataFrame:
    """Pairs of neighbours of which one or both are not broadcast, with their classes:
    (row, held_out, v, w, vp, wp, vc, wc, n); p is the place, n the count of w."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            place = np.frombuffer(b"".join(b.places), "<i4").astype(np.int64)
            row, held = np.repeat(b.row.to_numpy(), b.n_tokens), np.repeat(b.held_out.to_numpy(), b.n_tokens)
            word = np.zeros(len(place), np.int64)
            word[place < 0] = np.frombuffer(b"".join(b.far), "<i8")
            before = np.concatenate([[0], place[:-1]])
            at = np.flatnonzero((place < 0) | (before < 0))
            yield pd.DataFrame({"row": row[at], "held_out": held[at], "v": word[at - 1], "w": word[at], "vp": before[at], "wp": place[at]})

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for b in batches:
            for k in "vw":
                p, c = b[k + "p"].to_numpy(), b[k + "c"].to_numpy()
                b[k + "c"] = np.where(p >= 0, of[np.maximum(p, 0)], np.where(c >= 0, c, shapes[np.maximum(-p, 0)]))
            yield b

    rows = placed.select("row", "held_out", "n_tokens", "places", "far").mapInPandas(pairs, "row long, held_out boolean, v long, w long, vp long, wp long")
    far = tail.where("place < 0")
    # One join where one word is far; a second one only for the few pairs of two far words.
    two = (F.col("vp") < 0) & (F.col("wp") < 0)
    first, second = F.col("vp") < 0, F.col("wp") < 0
    names = ("row", "held_out", "v", "w", "vp", "wp", "vc", "wc", "n")
    one = rows.where(~two).withColumn("word", F.when(first, F.col("v")).otherwise(F.col("w"))).join(far.select("word", "c", "n"), "word", "left")
    one = one.withColumn("vc", F.when(first, F.col("c"))).withColumn("wc", F.when(second, F.col("c"))).withColumn("n", F.when(second, F.col("n"))).select(*names)
    both = (rows.where(two).join(far.select(F.col("word").alias("v"), F.col("c").alias("vc")), "v", "left")
            .join(far.select(F.col("word").alias("w"), F.col("c").alias("wc"), "n"), "w", "left").select(*names))
    both = one.unionByName(both).select(*names[:6], *[F.coalesce(k, F.lit(j)).alias(k) for k, j in (("vc", -1), ("wc", -1), ("n", 0))])
    return stored(both.mapInPandas(classed, both.schema), "pairs")


def far_entries(pairs: DataFrame, model: Any, buckets: int) -> DataFrame:
    """Entries of tail words from the pairs of ``linked``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = model.value["hashes"]
        for b in batches:
            v, w, vp, wp, vc, wc = (b[k].to_numpy() for k in ("v", "w", "vp", "wp", "vc", "wc"))
            word = lambda x, p: np.where(p < 0, x.view(np.uint64), hashes[np.maximum(p, 0)])
            x, y = (wp < 0) | (wp > HEAD), (vp < 0) | (vp > HEAD)
            yield bucketed(np.concatenate([word(w, wp)[x], word(v, vp)[y]]), np.concatenate([vc[x], wc[y] + CLASSES]), np.concatenate([wc[x], vc[y]]), buckets)

    return pairs.select("v", "w", "vp", "wp", "vc", "wc").mapInPandas(run, "bucket long, word binary, slot binary, now binary, n binary")


def bigrams(training: DataFrame, pairs: DataFrame, known: np.ndarray) -> np.ndarray:
    """Class bigram counts of the training texts."""
    shared = training.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, total = shared.value, np.zeros(CLASSES * CLASSES, np.int64)
        for b in pieces(batches):
            place = np.frombuffer(b"".join(b.places), "<i4").astype(np.int64)
            before = np.concatenate([[0], place[:-1]])[:len(place)]
            at = (place >= 0) & (before >= 0)
            total += np.bincount(of[before[at]] * CLASSES + of[place[at]], minlength=CLASSES * CLASSES)
        yield pd.DataFrame({"cell": np.flatnonzero(total), "n": total[total > 0]})

    near = training.select("places").mapInPandas(run, "cell long, n long")
    far = pairs.groupBy((F.col("vc") * CLASSES + F.col("wc")).alias("cell")).agg(F.count("*").alias("n"))
    out = np.zeros(CLASSES * CLASSES)
    for r in near.unionByName(far).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(CLASSES, CLASSES)


def probabilities(classes: np.ndarray, table: np.ndarray, count: np.ndarray, tail: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """log10 of P(class | class) and, by unit, of P(unit | class); ``tail`` is
    what words that are no units have of each class."""
    count = count + 0.5
    size = np.bincount(classes, weights=count, minlength=CLASSES) + tail
    general = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
    moves = (table + PRIOR * general) / (table.sum(axis=1, keepdims=True) + PRIOR)
    return np.log10(moves), np.log10(count / size[classes])


def vocabulary(training: DataFrame) -> tuple[Any, np.ndarray]:
    """The broadcast words, by place: hashes, counts and units (place 0 is the
    end); and by shape unit the different words of the tail."""
    spark = training.sparkSession
    words = word_counts(training)
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = frequent(words).toPandas().sort_values(["n", "word"], ascending=[False, True])
    ends = words.where("unit = 0").first()
    hashes = np.append(END, top.word.to_numpy(np.int64).view(np.uint64))
    counts = np.append(ends["n"] if ends else 0, top.n.to_numpy(np.int64))
    units = np.append(0, top.unit.to_numpy(np.int64))
    units[:1 + HEAD] = np.arange(len(units[:1 + HEAD]))
    head = spark.createDataFrame(pd.DataFrame({"word": hashes[:1 + HEAD].view(np.int64)}), "word long")
    kinds = np.zeros(UNITS)
    for r in words.where("unit > 0").join(F.broadcast(head), "word", "left_anti").groupBy("unit").agg(F.count("*").alias("v")).collect():
        kinds[r.unit] = r.v
    order = np.argsort(hashes)
    return spark.sparkContext.broadcast({
        "words": hashes[order], "places": order, "hashes": hashes, "counts": counts, "units": units,
        "tokens": total["n"] or 0, "different": total["v"]}), kinds


def tail_clustered(placed: DataFrame, model: Any, classes: np.ndarray, table: np.ndarray, rounds: int = TAIL_ROUNDS) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """(tail words with their classes, linked pairs of all texts, classes by place, class bigrams)."""
    m = model.value
    training = placed.where(~F.col("held_out"))
    known, buckets = classes[m["units"]], 1 + m["tokens"] // BUCKET
    entries = near_entries(training, known, classes, model, buckets)
    for k in range(rounds):
        released(placed.sparkSession)
        tail = moved(entries, table, model)
        known = known.copy()
        found = tail.where("place >= 0").select("place", "c").toPandas()
        known[found.place.to_numpy(np.int64)] = found.c.to_numpy(np.int64)
        entries = None
        released(placed.sparkSession)
        pairs = linked(training if k < rounds - 1 else placed, tail, known, classes)
        table = bigrams(training, pairs.where(~F.col("held_out")), known)
        if k < rounds - 1:
            entries = near_entries(training, known, None, model, buckets).unionByName(far_entries(pairs, model, buckets))
    return tail, pairs, known, table


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """Learns from the documents whose crc32 of the id, as text, modulo ``folds``
    is not ``held``, and scores all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held)
    model, kinds = vocabulary(rows.where(~F.col("held_out")))
    m = model.value
    all_tokens, different = m["tokens"], m["different"]
    placed = sequences(rows, model)
    classes, table, count = clustered(placed.where(~F.col("held_out")), model)
    tail, pairs, known, table = tail_clustered(placed, model, classes, table)
    left = np.zeros(CLASSES)
    for r in tail.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        left[r.c] = r.n - DISCOUNT * r.v
    # Of a shape unit, only its unseen words are left.
    count = np.where(np.arange(UNITS) > HEAD, DISCOUNT * kinds, count)
    moves, emits = probabilities(classes, table, count, left)
    size = np.bincount(classes, weights=count + 0.5, minlength=CLASSES) + left
    share = np.where(np.arange(len(known)) > HEAD, np.log10(np.maximum(m["counts"] - DISCOUNT, DISCOUNT) / size[known]), emits[m["units"]])
    shared = spark.sparkContext.broadcast({"known": known, "share": share})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for b in pieces(batches):
            place = np.frombuffer(b"".join(b.places), "<i4").astype(np.int64)
            owner = np.repeat(np.arange(len(b)), b.n_tokens)
            before = np.concatenate([[0], place[:-1]])[:len(place)]
            p, q = np.maximum(place, 0), np.maximum(before, 0)
            each = np.where(place >= 0, of["share"][p], 0.0) + np.where((place >= 0) & (before >= 0), moves[of["known"][q], of["known"][p]], 0.0)
            b["share"] = np.bincount(owner, weights=each, minlength=len(b))
            yield b[["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share"]]

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far, n, c = b.wp.to_numpy() < 0, b.n.to_numpy(), b.wc.to_numpy()
            own = np.where(n > 0, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / size[c]), emits[np.maximum(-b.wp.to_numpy(), 0)])
            yield pd.DataFrame({"row": b.row, "known": (far & (n > 0)).astype(np.int64),
                                "base": np.where(far, np.log10((n + 1) / (all_tokens + different + 1)), 0.0),
                                "share": moves[b.vc.to_numpy(), c] + np.where(far, own, 0.0)})

    near = placed.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "places").mapInPandas(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double")
    far = (pairs.select("row", "wp", "vc", "wc", "n").mapInPandas(rest, "row long, known long, base double, share double")
           .groupBy("row").agg(F.sum("known").alias("far_known"), F.sum("base").alias("far_base"), F.sum("share").alias("far_share")))
    joined = near.join(far, "row", "left")
    score = F.col("share") + F.coalesce("far_share", F.lit(0.0))
    return null_ids(joined).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("far_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def op1_brown_lm(spark, sf_dir):
    return scored(load(spark, sf_dir, "documents"))


QUERIES = {"op1_brown_lm": op1_brown_lm}
ORACLES: dict[str, str] = {}
