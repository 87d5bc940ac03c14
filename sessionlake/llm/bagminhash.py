"""Near-duplicate detection by BagMinHash over multisets of word shingles.

The weight of a shingle is how often it occurs in a text. Every shingle has a
Poisson process for each dyadic range of weights ([0,1), [1,2), [2,4), ...), its
rate the width of the range. A point has a time, a register and, by halving the
range down to whole weights, a level; it counts for texts whose weight is above
that level. A register keeps its earliest point, so two texts agree in a
register with the probability of their weighted Jaccard similarity, sum of
minima by sum of maxima. Points are made in order of time and only until none
can change a register.

``BANDS`` bands of ``ROWS`` registers make candidates: similar texts (0.8 or
more) share a band but for 8e-5 of the cases at 0.8 itself, fewer above.
Candidates are verified exactly, from whole texts.

Equal texts are first collapsed. Within a bucket nobody is paired with
everybody: all members meet the bucket's leader, the member that shares most
buckets with others, and those that are not connected with it by any bucket
meet a second one. What is left are pairs
across different classes of one bucket. Two texts can be similar without a rare
shingle in common (one that at most ``RARE`` of the texts left have) only if the
common shingles of both are enough for it; a text with many shingles of its own
is let go before any pair is made. Of the rest the sizes and the triangle
inequality of the distance exclude most (distances to the leader that differ by
more than 0.2). Pairs that do have a rare shingle in common meet by that
shingle, at most ``RARE`` texts at each, and stay if what they share of rare
shingles and the common ones are enough. All these bounds are exact and all
pairs left are verified, so no link between classes is lost.

Defined results: null texts are empty. A text of fewer than five words is one
shingle; texts without words are equal to each other. White space is no part
of a text's shingles. Null ids come after all others in a class. Rows that
agree in id and text are members of one class each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import load, null_ids, plain_ids, stored, texts

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 7
#: So many leaders of a bucket meet all members that are still open.
LEADERS = 2
#: A shingle is rare if at most so many of the texts in question have it.
RARE = 12
#: So many pairs are verified together.
TOGETHER = 512
U64 = np.uint64


# Shingles and signatures, inside tasks.


def shingles(chunk: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of all texts of a chunk, sorted by text and shingle."""
    starts, stops = kernel.runs(chunk, kernel.NOT_WHITE)
    word = kernel.hashes(chunk, starts, stops)
    owner = kernel.owners(ends, starts)
    n = len(ends)
    per_text = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            full = kernel.mixed(full + word[k:k + len(full)])
        left = per_text[owner[:len(full)]] - (np.arange(len(full)) - first[owner[:len(full)]])
        inside = left >= words
        text, found = owner[:len(full)][inside], full[inside]
        short = np.flatnonzero(per_text < words)
        only = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = per_text[short] > k
            only[has] = kernel.mixed(only[has] + word[first[short[has]] + k])
        only = kernel.mixed(only ^ U64(0xABCDEF))
    text, found = np.concatenate([text, short]), np.concatenate([found, only])
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(new)
    return text[at], found[at], np.diff(np.append(at, len(text)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The earliest times of the registers of ``n`` texts, (n, registers)."""
    best = np.full(n * registers, np.inf)
    # One process for each dyadic range of weights that the weight reaches into.
    state, owner, low, width, top = [], [], [], [], []
    for j in range(int(weight.max(initial=1)).bit_length() + 1):
        base, wide = (0, 1) if j == 0 else (1 << (j - 1), 1 << (j - 1))
        own = weight > base
        if not own.any():
            break
        state.append(kernel.mixed(shingle[own] ^ U64(0x51ED2701 * (j + 1))))
        owner.append(text[own])
        low.append(np.full(own.sum(), base))
        width.append(np.full(own.sum(), wide))
        top.append(weight[own])
    state, owner, low, width, top = map(np.concatenate, (state, owner, low, width, top))
    time, made, m = np.zeros(len(state)), 0, U64(registers)
    with np.errstate(over="ignore"):
        while len(state):
            # The next points of all processes, several at once where few processes are left.
            k = int(np.clip(100_000 // len(state), 1, 64))
            steps = np.arange(made + 1, made + k + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
            point = kernel.mixed(state[:, None] + steps)
            times = time[:, None] + np.cumsum(-np.log(((point >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None], axis=1)
            where = kernel.mixed(point ^ U64(0x1234567))
            register = ((where >> U64(32)) % m).astype(np.int64) + owner[:, None] * registers
            level = low[:, None] + ((where & U64(0x7FFFFFFF)).astype(np.int64) & (width[:, None] - 1))
            counts = level < top[:, None]
            np.minimum.at(best, register[counts], times[counts])
            time, made = times[:, -1], made + k
            active, place = np.unique(owner, return_inverse=True)
            more = time < best.reshape(n, registers)[active].max(axis=1)[place]
            state, owner, low, width, top, time = (x[more] for x in (state, owner, low, width, top, time))
    return best.reshape(n, registers)


def bands_of(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of each text."""
    bits = kernel.mixed(times.view(np.uint64)).reshape(len(times), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(times), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = kernel.mixed(out + bits[:, :, r])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = np.minimum(a[1][same], b[1][at[same]]).sum()
    return common / (a[1].sum() + b[1].sum() - common)


# Spark jobs.


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, content, size, bands) of every document; content is the text's digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, chunk, ends in kernel.chunks(b.text.tolist()):
                text, shingle, weight = shingles(chunk, ends)
                n = len(ends)
                found = bands_of(signatures(text, shingle, weight, n, bands * rows), bands, rows)
                size = np.bincount(text, weights=weight, minlength=n).astype(np.int64)
                part = b.iloc[first:first + n]
                yield pd.DataFrame({"doc_id": part.doc_id, "content": part.content, "size": size, "bands": list(found)})

    keyed = texts(docs, id_col, text_col).withColumn("content", F.unhex(F.sha2("text", 256)))
    return stored(null_ids(plain_ids(keyed).mapInPandas(run, "doc_id long, content binary, size long, bands array<long>")), "signed")


def contents(marked: DataFrame) -> DataFrame:
    """One row per different text: cid, content, doc_id (least), copies, size, bands."""
    found = marked.groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    return stored(found.withColumn("cid", F.monotonically_increasing_id()), "contents")


def buckets(different: DataFrame) -> DataFrame:
    """(bucket, cid, size, central) for all buckets with several members;
    ``central`` counts the places beside the text in all its buckets."""
    rows = different.select("cid", "size", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "cid", "size")
    found = rows.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    return stored(found.withColumn("central", F.sum("n").over(Window.partitionBy("cid"))).drop("n"), "buckets")


def verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the exact similarity of their whole texts."""
    left, right = held.select(F.col("cid").alias("a"), F.col("text").alias("ta")), held.select(F.col("cid").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                b = batch.iloc[first:first + TOGETHER]
                # Each text of these pairs is shingled once.
                cids, at, which = np.unique(np.concatenate([b.a, b.b]), return_index=True, return_inverse=True)
                both = [*b.ta, *b.tb]
                parts = []
                for _, chunk, ends in kernel.chunks([both[k] for k in at]):
                    text, shingle, weight = shingles(chunk, ends)
                    begin = np.searchsorted(text, np.arange(len(ends) + 1))
                    parts += [(shingle[x:y], weight[x:y]) for x, y in zip(begin, begin[1:])]
                found = [similarity(parts[x], parts[y]) for x, y in which.reshape(2, -1).T]
                yield pd.DataFrame({"a": b.a, "b": b.b, "similarity": np.asarray(found, float)})

    joined = pairs.join(left, "a").join(right, "b")
    return stored(joined.mapInPandas(run, "a long, b long, similarity double"), "verified")


def rare_shingles(held: DataFrame, most: int = RARE) -> DataFrame:
    """(cid, shingle, weight, n) of all shingles that at most ``most`` texts of ``held`` have (n)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, chunk, ends in kernel.chunks(b.text.tolist()):
                text, shingle, weight = shingles(chunk, ends)
                yield pd.DataFrame({"cid": b.cid.to_numpy()[first + text], "shingle": shingle.view(np.int64), "weight": weight})

    rows = stored(held.select("cid", "text").mapInPandas(run, "cid long, shingle long, weight long"), "shingles")
    rare = rows.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return stored(rows.join(rare, "shingle"), "rare")


def _by_rare(rare: DataFrame, members: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of different classes that share a rare shingle, and enough of all."""
    rows = rare.where("n > 1").join(members, "cid").select("shingle", "cid", "weight", "size", "label", "common")
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.cid") > F.col("y.cid")) & (F.col("x.label") != F.col("y.label")) & _fits("x.size", "y.size", similar))
    shared = met.select(
        F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.least("x.weight", "y.weight").alias("w"),
        F.least("x.common", "y.common").alias("common"), (F.col("x.size") + F.col("y.size")).alias("sizes")).groupBy("a", "b").agg(
            F.sum("w").alias("w"), F.first("common").alias("common"), F.first("sizes").alias("sizes"))
    return shared.where(F.col("w") + F.col("common") >= F.col("sizes") * (similar / (1 + similar)) - 1e-6).select("a", "b")


def _hopeful(inner: DataFrame, similar: float) -> DataFrame:
    """The members of buckets that may be similar to a member of another class by common shingles.

    ``reach`` is the greatest size that such a text can have: what two similar
    texts have in common is at least ``similar / (1 + similar)`` of both sizes.
    """
    while True:
        per_bucket = inner.groupBy("bucket").agg(
            F.min("label").alias("x"), F.max("label").alias("y"), F.min("size").alias("least"), F.max("reach").alias("most"), F.count("*").alias("n"))
        fewer = stored(inner.join(per_bucket.where("x < y"), "bucket").where(
            (F.col("reach") >= F.greatest(F.col("least"), F.col("size") * similar) - 1e-6) & (F.col("most") >= F.col("size") - 1e-6)), "inner")
        left = fewer.groupBy("bucket").agg(F.count("*").alias("m"), F.first("n").alias("n")).agg(F.sum("m"), F.sum("n")).first()
        inner = fewer.select(*inner.columns)
        # Another round pays where buckets have lost a good part of their members.
        if not left[0] or left[0] > 0.9 * left[1]:
            return inner


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cid, label) for all nodes of ``links`` (a, b) but the least one of each
    component, which is the label. ``known`` has the same of links that count as well."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        edges = edges.union(known.select("cid", "label"))
    node = Window.partitionBy("u")
    while True:
        # Every greater neighbour of a node moves to the least of all it is next to, then every lesser one.
        both = edges.union(edges.select("v", "u"))
        large = both.withColumn("m", F.least(F.min("v").over(node), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(node)).select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        if _stars(edges):
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one, which has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select(F.col("v"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.bool_or(F.expr("down > 1 OR (down = 1 AND up = 1)"))).first()[0]


def _fits(a: str, b: str, similar: float):
    """Texts whose sizes differ too much can't be similar."""
    return F.least(a, b) >= F.greatest(a, b) * similar


def linked(different: DataFrame, held_by, similar: float = SIMILAR) -> DataFrame:
    """(cid, label) of all texts that are connected with a lesser one.

    ``held_by(cids)`` gives (cid, text) of the cids in its argument.
    """
    rows = buckets(different)
    held = stored(held_by(rows.select("cid").distinct()), "held")
    checked, labels, open_ = None, None, rows
    bucket = Window.partitionBy("bucket")
    for _ in range(LEADERS):
        # Every open member of a bucket meets the one that has most in common with others.
        led = open_.withColumn("lead", F.max(F.struct("central", "cid", "size")).over(bucket))
        met = led.where((F.col("cid") != F.col("lead.cid")) & _fits("size", "lead.size", similar))
        pairs = met.select(F.col("cid").alias("a"), F.col("lead.cid").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            break
        more = verify(pairs, held)
        checked = more if checked is None else checked.union(more)
        labels = components(more.where(F.col("similarity") >= similar).select("a", "b"), labels)
        # Those that are not connected with the leader stay open, without it.
        classed = open_.join(labels, "cid", "left").select("bucket", "cid", "size", "central", F.coalesce("label", "cid").alias("label"))
        led = classed.withColumn("led", F.max(F.struct("central", "cid", "label")).over(bucket)["label"])
        open_ = stored(led.where(F.col("label") != F.col("led")).select("bucket", "cid", "size", "central"), "open")
    if labels is None:
        return different.select("cid", F.col("cid").alias("label")).limit(0)
    # Pairs across the classes of a bucket that the bounds leave; each pair in one of its buckets.
    classed = rows.join(labels, "cid", "left").select("bucket", "cid", "size", "central", F.coalesce("label", "cid").alias("label"))
    mixed_ = classed.withColumns({"x": F.min("label").over(bucket), "y": F.max("label").over(bucket), "lead": F.max(F.struct("central", "cid")).over(bucket)["cid"]}).where("x < y")
    known = checked.select(F.col("a").alias("cid"), F.col("b").alias("lead"), (1 - F.col("similarity")).alias("far"))
    inner = (mixed_.join(known, ["cid", "lead"], "left")
             .withColumn("far", F.when(F.col("cid") == F.col("lead"), F.lit(0.0)).otherwise(F.col("far"))))
    inner = stored(inner.select("bucket", "cid", "size", "label", "far"), "inner")
    members = inner.select("cid", "size", "label").distinct()
    rare = rare_shingles(held.join(members, "cid", "left_semi"))
    own = rare.groupBy("cid").agg(F.sum("weight").alias("own"))
    members = stored(members.join(own, "cid", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0))), "members")
    reach = F.col("common") * ((1 + similar) / similar) - F.col("size")
    inner = _hopeful(inner.join(members.drop("size", "label"), "cid").select("bucket", "cid", "size", "label", "far", reach.alias("reach")), similar)
    # Of all its buckets a text brings those that are left; mostly that is a few of BANDS.
    inner = inner.withColumn("buckets", F.collect_list("bucket").over(Window.partitionBy("cid")))
    x, y = inner.alias("x"), inner.alias("y")
    first = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")
    within = (F.col("x.size") <= F.col("y.reach") + 1e-6) & (F.col("y.size") <= F.col("x.reach") + 1e-6)
    near = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 1 - similar + 1e-9, F.lit(True))
    # Files of arrays are small beside their rows, so Spark would broadcast too much.
    by_common = x.join(y.hint("merge"), F.col("x.bucket") == F.col("y.bucket")).where(
        (F.col("x.cid") > F.col("y.cid")) & (F.col("x.label") != F.col("y.label")) & near & within & _fits("x.size", "y.size", similar) & first)
    by_common = by_common.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    pairs = by_common.union(_by_rare(rare, members, similar)).distinct()
    pairs = stored(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "across")
    if pairs.isEmpty():
        return labels
    more = verify(pairs, held)
    return components(more.where(F.col("similarity") >= similar).select("a", "b"), labels)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class),
    class_size, kept (one row of each class), content."""
    marked = signed(docs, id_col, text_col)
    different = contents(marked)
    every = texts(docs, id_col, text_col).select(F.unhex(F.sha2("text", 256)).alias("content"), "doc_id", "text")

    def held_by(cids: DataFrame) -> DataFrame:
        wanted = different.join(cids, "cid").select("cid", "content", "doc_id")
        rows = every.join(wanted, (every.content == wanted.content) & every.doc_id.eqNullSafe(wanted.doc_id)).select("cid", "text")
        return rows.dropDuplicates(["cid"])

    labels = linked(different, held_by, similar)
    classed = stored(different.drop("bands").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "classed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("content"))
    per_class = classed.groupBy("label").agg(F.min(order).alias("best"), F.sum("copies").alias("class_size"))
    by_content = classed.join(per_class, "label").select(
        "content", F.col("best.doc_id").alias("class_id"), "class_size", F.col("best.content").alias("best_content"))
    return marked.select("doc_id", "content").join(by_content, "content").select(
        "doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("content") == F.col("best_content"))).alias("kept"), "content")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    kept = near_classes(docs, id_col, text_col).where("kept").select(F.struct("content", "doc_id").alias("key"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.struct(F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("content"), F.col(id_col).cast("long").alias("doc_id")).alias("key"))
    return keyed.join(kept.distinct(), "key").dropDuplicates(["key"]).select("doc.*")


def op10_near_dedup(spark, sf_dir):
    return near_classes(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
