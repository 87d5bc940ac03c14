"""Removal of repeated passages by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere
else. To find those strings without sorting all suffixes of the corpus:

* Every string of LENGTH bytes has an anchor, the K bytes in it with the least
  hash, the first of them. Equal strings have equal anchors at equal places, so
  only strings of one anchor need to be compared. The starts with one anchor
  are neighbours; with the bytes they need they make a piece.
* Pieces whose anchor occurs once are done: nothing in them is repeated. Equal
  pieces are counted where they are found; all their starts are repeated.
* Different pieces of one anchor meet in a bucket. Each half of a bucket, a
  shard, has the Burrows-Wheeler transform of its pieces. The transforms are
  merged by refining their interleave: LENGTH stable passes by the next symbol
  to the left, each of which sorts the merged order by one more symbol; STEP of
  them are made at once. A pass holds the suffixes that starts depend on, those as
  many symbols right of a start as are still to come. What is
  told apart from all others is dropped, and what is left at the end are repeated
  strings of LENGTH bytes; lengths of common prefixes are not derived (``merged``,
  which gives them, is not used by the query). The suffixes of both shards are not
  sorted again.
* An anchor with more than ``MANY`` different pieces would make too large a
  bucket. Its strings are counted by their hashes instead, in an aggregation
  that has no hot group. This is exact as well.

Texts are shuffled twice: to fetch pieces, and to cut what is repeated.

Defined results: null texts are empty; texts under LENGTH bytes stay whole.
Rows that repeat are documents of their own, so all of their strings are
repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import load, stored, texts

LENGTH, K = 200, 32
MANY = 4096
BUCKET_BYTES = 100_000
#: Passes of the merge that are made at once, a power of two of at most 4.
STEP = 4
_PLACE = 21
_SEGMENT = 1 << 20
U64 = np.uint64


# Inside tasks.


def segments(raw: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts as groups of (text, offset, bytes) of a bounded size; a long text
    is cut into overlapping segments, so that each start is in one of them."""
    who, base, parts, held = [], [], [], 0
    for k, b in enumerate(raw):
        for at in range(0, max(1, len(b) - length + 1), _SEGMENT):
            part = b[at:at + _SEGMENT + length - 1]
            if held and held + len(part) > 1.5 * _SEGMENT:
                yield who, base, parts
                who, base, parts, held = [], [], [], 0
            if len(part) >= length:
                who.append(k)
                base.append(at)
                parts.append(part)
                held += len(part)
    if parts:
        yield who, base, parts


def pieces(buffer: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor hash, piece hash) of all pieces;
    ``ends`` are the ends of the segments in the buffer."""
    n = len(buffer)
    grams = np.arange(n - k + 1)
    value = kernel.hashes(buffer, grams, grams + k)
    ranked = (value >> U64(_PLACE) << U64(_PLACE)) | grams.astype(np.uint64)
    width, reach = 1, length - k + 1
    while 2 * width <= reach:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    if reach > width:
        ranked = np.minimum(ranked[:len(ranked) - (reach - width)], ranked[reach - width:])
    anchor = (ranked & U64((1 << _PLACE) - 1)).astype(np.int64)  # of every start
    begins = np.concatenate([[0], ends[:-1]])
    segment = kernel.owners(ends, np.arange(len(anchor)))
    valid = np.arange(len(anchor)) + length <= ends[segment]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[begins[begins < len(new)]] = valid[begins[begins < len(new)]]
    first = np.flatnonzero(new)
    count = np.diff(np.append(np.cumsum(valid)[first] - 1, valid.sum()))
    whole = kernel.hashes(buffer, first, first + count + length - 1)
    with np.errstate(over="ignore"):
        whole = kernel.mixed(whole + kernel.mixed((anchor[first] - first).astype(np.uint64) * U64(1 << 20) + count.astype(np.uint64)))
    return first, count, value[anchor[first]], whole


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix array) of a collection; every string ends in a symbol
    0 of its own, less than all bytes, the earlier string's first. Symbols are bytes + 1."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    stops = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(int(stops[-1]) + 1, np.int64)
    symbols[np.delete(np.arange(len(symbols)), stops)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    n, rank = len(symbols), symbols + len(strings) - 1
    rank[stops] = np.arange(len(strings))
    # Ranks by as many symbols as fit a number, then by twice as many each time.
    span, h = 256 + len(strings), 1
    while span**2 < 2**62:
        rank = rank * span + np.append(rank[h:], np.zeros(min(h, n), np.int64))
        span, h = span**2, 2 * h
    while True:
        order = np.argsort(rank)
        sorted_ = rank[order]
        fresh = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if fresh[-1] == n - 1:
            break
        rank[order] = fresh
        rank = rank * (n + 1) + np.append(rank[h:] + 1, np.zeros(min(h, n), np.int64))
        h *= 2
    before = symbols[order - 1]  # the first string is preceded by the last one's end
    return before.astype(np.uint16), order


def merged(left: np.ndarray, right: np.ndarray, strings: tuple[int, int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms, sorted by ``depth`` symbols, and for each
    place the common prefix with the place before (``depth`` if not told apart)."""
    a, b = strings
    which = np.concatenate([np.zeros(len(left), bool), np.ones(len(right), bool)])
    block = np.zeros(len(which), np.int32)
    common = np.full(len(which), depth, np.int16)
    common[0] = 0
    ends = np.concatenate([np.zeros(a, bool), np.ones(b, bool)])  # the ends of strings come first, in this order
    symbol = np.empty(len(which), np.uint16)
    for h in range(1, depth + 1):
        symbol[~which], symbol[which] = left, right
        order = np.argsort(symbol, kind="stable")[a + b:]
        by = symbol[order]
        new = np.ones(len(which), bool)
        was = block[order]
        new[a + b + 1:] = (by[1:] != by[:-1]) | (was[1:] != was[:-1])
        which = np.concatenate([ends, which[order]])
        common[new & (common == depth)] = h - 1
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == len(block):
            break
    return which, common


def alike(left: np.ndarray, right: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries (shard, place in its order) of the suffixes of two transforms
    that share their first ``depth`` symbols with another one.

    The same refinement as ``merged``, but what is told apart from all others is
    dropped: then the suffixes that begin further left are as well. Up to ``STEP``
    passes are one: a stable sort by that many symbols to the left. ``wanted``
    has the entries of both orders that lie ``depth`` symbols right of those asked
    for; without it all are.
    """
    both, split = np.concatenate([left, right]), len(left)
    back = np.empty(len(both), np.uint32)  # where the suffix that begins one symbol earlier stands
    for at, shard in ((0, left), (split, right)):
        back[at + np.argsort(shard, kind="stable")] = at + np.arange(len(shard))
    # The symbols to the left, the nearest last; not for suffixes that few symbols stand before.
    steps = [(1, back, (both - 1).astype(np.uint8).astype(np.uint64), both == 0)]
    while 2 * steps[-1][0] <= min(STEP, depth):
        width, back, symbols, short = steps[-1]
        steps.append((2 * width, back[back], symbols[back] << U64(8 * width) | symbols, short | short[back]))
    entry = np.arange(len(both)) if wanted is None else np.flatnonzero(wanted)
    block, left_over = np.zeros(len(entry), np.int32), depth
    while left_over and len(entry):
        # The widest step that divides what is left.
        width, back, symbols, short = steps[min((left_over & -left_over).bit_length(), len(steps)) - 1]
        left_over -= width
        starts = short[entry]
        if starts.any():
            entry, block = entry[~starts], block[~starts]
        ranked = np.sort(symbols[entry] << U64(32) | np.arange(len(entry), dtype=np.uint64))
        order, by = (ranked & U64(0xFFFFFFFF)).astype(np.int64), ranked >> U64(32)
        was = block[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (by[1:] != by[:-1]) | (was[1:] != was[:-1])
        many = ~(new[:-1] & new[1:])
        block = np.cumsum(new[:-1], dtype=np.int32)[many]
        entry = back[entry[order[many]]]
    return entry >= split, np.where(entry >= split, entry - split, entry).astype(np.int64)


def repeated_starts(strings: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string a mask of its first ``counts`` starts: whether the
    ``length`` bytes from there also start elsewhere in the collection. A string
    ends with the bytes of its last start."""
    half = -(-len(strings) // 2)
    transforms, arrays = [np.zeros(0, np.uint16)] * 2, [np.zeros(0, np.int64)] * 2
    for k, shard in enumerate((strings[:half], strings[half:])):
        if shard:
            transforms[k], arrays[k] = transform(shard)
    counts = np.asarray(counts, np.int64)
    begins = np.cumsum([0, *(len(s) + 1 for s in strings[:-1])])
    places = np.concatenate([arrays[0], arrays[1] + len(arrays[0])])
    # Of all suffixes those ``length`` bytes right of a start, on which the starts depend.
    each = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    wanted = np.zeros(len(places), bool)
    wanted[each + length] = True
    which, at = alike(transforms[0], transforms[1], length, wanted[places])
    found = np.zeros(len(places), bool)
    found[places[at + which * len(arrays[0])]] = True
    return [found[b:b + c] for b, c in zip(begins.tolist(), counts.tolist())]


def _spans(mask: np.ndarray) -> list[int]:
    """Starts and ends of the runs of a mask, in turn."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return turns.tolist()


def cut(raw: bytes, starts: list[int], length: int = LENGTH) -> tuple[int, int, str, list[tuple[int, int]]]:
    """(removed bytes, spans, digest of what stays, the spans); ``starts`` has
    first and last + 1 of runs of repeated starts, in turn."""
    if not starts:
        return 0, 0, hashlib.sha256(raw).hexdigest(), []
    runs = np.array(starts, np.int64).reshape(-1, 2)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    runs[:, 1] += length - 1
    reach = np.maximum.accumulate(runs[:, 1])
    first = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
    begin = runs[first, 0]
    end = reach[np.append(np.flatnonzero(first)[1:] - 1, len(runs) - 1)]
    kept, at = hashlib.sha256(), 0
    for b, e in zip(begin.tolist(), end.tolist()):
        kept.update(raw[at:b])
        at = e
    kept.update(raw[at:])
    return int((end - begin).sum()), len(begin), kept.hexdigest(), list(zip(begin.tolist(), end.tolist()))


# Spark jobs.

_KEY = ["doc_id", "sum"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sum, text): rows of one id and text are alike, others differ in the key."""
    t = texts(docs, id_col, text_col)
    return t.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("sum"), "text",
                    F.col("doc_id").cast("long").alias("id"))


def _released(frame: DataFrame, name: str) -> DataFrame:
    """``stored``, and the shuffle files of what is no longer referred to are given back."""
    out = stored(frame, name)
    del frame
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def all_pieces(keyed: DataFrame) -> DataFrame:
    """(doc_id, sum, lo, live, anchor, piece) of all texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode() for t in b.text]
            ids, sums = b.doc_id.to_numpy(), b["sum"].to_numpy()
            for who, base, parts in segments(raw):
                ends = np.cumsum([len(p) for p in parts])
                first, count, anchor, piece = pieces(np.frombuffer(b"".join(parts), np.uint8), ends)
                s = kernel.owners(ends, first)
                text = np.array(who)[s]
                lo = first - np.concatenate([[0], ends[:-1]])[s] + np.array(base)[s]
                yield pd.DataFrame({"doc_id": ids[text], "sum": sums[text], "lo": lo, "live": count.astype(np.int32),
                                    "anchor": anchor.view(np.int64), "piece": piece.view(np.int64)})

    return stored(keyed.select("doc_id", "sum", "text").where(F.octet_length("text") >= LENGTH).mapInPandas(
        run, "doc_id long, sum long, lo long, live int, anchor long, piece long"), "pieces")


def _fetched(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (anchor, piece, rep, live, kinds) with the bytes of each piece."""
    by_doc = wanted.select("rep.doc_id", "rep.sum", F.struct("anchor", "piece", "kinds", "rep.lo", "live").alias("w")).groupBy(*_KEY).agg(F.collect_list("w").alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, ws in zip(b.text, b.w):
                raw = text.encode()
                rows += [(w["anchor"], w["piece"], w["kinds"], w["live"], raw[w["lo"]:w["lo"] + w["live"] + LENGTH - 1]) for w in ws]
            yield pd.DataFrame(rows, columns=["anchor", "piece", "kinds", "live", "bytes"])

    rows = keyed.select(*_KEY, "text").join(by_doc, _KEY).select("text", "w")
    return rows.mapInPandas(run, "anchor long, piece long, kinds long, live int, bytes binary").dropDuplicates(["anchor", "piece"])


def _by_merging(held: DataFrame) -> DataFrame:
    """(anchor, piece, starts) for the pieces of anchors with at most MANY of them."""
    buckets = held.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    n = max(1, -(-buckets // BUCKET_BYTES))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece", "anchor"])  # shards are halves of the order of piece hashes
        masks = repeated_starts(frame["bytes"].tolist(), frame.live.to_numpy())
        out = pd.DataFrame({"anchor": frame.anchor, "piece": frame.piece, "starts": [_spans(m) for m in masks]})
        return out[out.starts.map(len) > 0]

    return (held.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n))).groupBy("bucket")
            .applyInPandas(run, "anchor long, piece long, starts array<long>"))


def _by_counting(held: DataFrame) -> DataFrame:
    """The same for the pieces of other anchors, start by start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for anchor, piece, live, raw in zip(b.anchor, b.piece, b.live, b["bytes"]):
                at = np.arange(live)
                string = kernel.hashes(np.frombuffer(raw, np.uint8), at, at + LENGTH)
                yield pd.DataFrame({"anchor": anchor, "piece": piece, "at": at, "string": string.view(np.int64)})

    each = stored(held.mapInPandas(run, "anchor long, piece long, at long, string long"), "strings")
    twice = each.groupBy("anchor", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = each.join(twice, ["anchor", "string"]).groupBy("anchor", "piece").agg(F.collect_list("at").alias("at"))
    return found.select("anchor", "piece", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("starts"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sum, starts): runs of repeated starts of every text that has any, by first and last + 1."""
    keyed = _keyed(docs, id_col, text_col)
    every = all_pieces(keyed)
    anchors = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = _released(every.join(anchors, "anchor"), "repeated")
    kinds = stored(again.groupBy("anchor", "piece").agg(
        F.count("*").alias("n"), F.first("live").alias("live"), F.min(F.struct("doc_id", "sum", "lo")).alias("rep")), "kinds")
    different = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = stored(kinds.join(different, "anchor").select("anchor", "piece", "rep", "live", "kinds"), "wanted")
    held = _released(_fetched(keyed, wanted), "held")
    found = _by_merging(held.where(F.col("kinds") <= MANY)).unionByName(_by_counting(held.where(F.col("kinds") > MANY)))
    # Pieces that occur twice are repeated whole.
    whole = kinds.where("n > 1").select("anchor", "piece", F.array(F.lit(0).cast("long"), F.col("live").cast("long")).alias("starts"))
    once = found.join(kinds.where("n = 1").select("anchor", "piece"), ["anchor", "piece"])
    starts = stored(whole.unionByName(once), "starts")
    placed = again.join(starts, ["anchor", "piece"]).select(*_KEY, F.expr("transform(starts, x -> x + lo)").alias("starts")).distinct()
    return _released(placed.groupBy(*_KEY).agg(F.flatten(F.collect_list("starts")).alias("starts")), "runs")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""
    runs = repeated(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, starts in zip(b.text, b.starts):
                raw = text.encode()
                removed, n, digest, spans = cut(raw, [] if starts is None else list(starts))
                rows.append((len(raw), removed, n, digest, [{"begin": x, "end": y} for x, y in spans]))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            out.insert(0, "doc_id", b.id.astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    joined = _keyed(docs, id_col, text_col).join(runs, _KEY, "left").select("id", "text", "starts")
    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")


def op5_repeats(spark, sf_dir):
    return without_repeats(load(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op5_repeats": op5_repeats}
ORACLES: dict[str, str] = {}
