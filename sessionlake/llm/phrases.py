"""Phrase collocations from a weighted de Bruijn graph.

Each word of a piece starts a longest gram: itself and the next two words, or
fewer where the piece ends. Grams of three words are edges, from the node of
their first two words to that of their last two; shorter ones are the
corrections of nodes and words at which a piece ends. Edges are aggregated once.
The count of a node is the flow out of it, its edges plus its corrections; that
of a word is the same over all nodes that start with it. So no shorter gram is
ever counted in the texts.

The graph of frequent edges is then compacted: an inner node has one edge in and
one out that carry all its flow, and maximal chains over inner nodes become
unary paths, found by pointer doubling. Inner nodes are no phrases of their own,
and their count is the flow of their path.

Grams are strings, so counts are exact; scores are decimals of 38 digits. Texts
are not shuffled. A task sums up the grams of some millions of words in numbers
of its own for the words, then rows (first two words, third word, count) are
dealt by the first two, so that a node and its edges meet and nothing but
frequent grams and words moves again. A task holds the grams of one partition,
whose size is the session's. Pairs of words that a sample of documents
shows to be very frequent (at most ``1 / HOT`` of them) are spread over
``SALTS`` tasks; the sample decides about places only, never about counts.
Ranking goes by a tree of tasks, none of which holds a language.

Defined results: a null text is empty, a null language is ``und``. Repeated rows
count each. Documents without words give no phrases, nor does an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, stored

MIN_COUNT = 10
TOP = 2000
PIECE_END = r"[.,;:!?\x0A-\x0D]"
WORDS = r"[^\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many parts of a language are ranked by themselves, then so many at a time together.
PARTS, FAN_IN = 256, 16
#: A pair of words is hot if it starts this share of the grams in a sample of so many documents.
HOT, SAMPLE, SALTS = 1 / 1024, 2_000, 64
#: Words that a task numbers and sums up at once; three numbers fit one of 64 bits.
WINDOW, SLICE, NAMES = 3_000_000, 1_000_000, 1 << 21
#: A-Z in lower case, all ends of pieces as one.
TABLE = bytes.maketrans(UPPER.encode() + b",;:!?\x0A\x0B\x0C\x0D", LOWER.encode() + b"." * 9)


class _Stream:
    """The words of one language in a task, numbered window by window; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.kept = lang, [b".", b"."]
        self._restart()

    def _restart(self):
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.parts = []
        self.add([b".", *self.kept])

    def add(self, words: list[bytes]):
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.kept = (self.kept + words[-2:])[-2:]

    def grams(self, hot: pa.Array, last: bool) -> Iterator[pa.RecordBatch]:
        """The grams from all words of the window, but the last two, which start the next one."""
        if last:
            self.add([b".", b"."])
        w = np.concatenate(self.parts)
        names, v = pa.array(list(self.number), pa.binary()).cast(pa.string()), len(self.number)
        self._restart()
        one, two, three = w[:-2], w[1:-1], np.where(w[1:-1] == 0, 0, w[2:])
        code, n = np.unique(((one * v + two) * v + three)[one > 0], return_counts=True)
        for at in range(0, len(code), 500_000):
            pair, third = np.divmod(code[at:at + 500_000], v)
            nodes, place = np.unique(pair, return_inverse=True)
            first, second = names.take(pa.array(nodes // v)), names.take(pa.array(nodes % v))
            phrase = pc.if_else(pa.array(nodes % v == 0), first, pc.binary_join_element_wise(first, second, " "))
            head = pc.binary_join_element_wise(phrase, pa.scalar(self.lang), "\n")
            salted = pc.is_in(head, value_set=hot).to_numpy(zero_copy_only=False)[place]
            word, salt = pc.if_else(pa.array(third == 0), "", names.take(pa.array(third))), np.zeros(len(third), np.int32)
            salt[salted] = [zlib.crc32(x.encode()) % SALTS + 1 for x in word.filter(pa.array(salted)).to_pylist()]
            yield pa.RecordBatch.from_arrays([head.take(pa.array(place)), word, pa.array(salt), pa.array(n[at:at + 500_000])], names=["head", "word", "salt", "n"])


def grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", hot: tuple[str, ...] = ()) -> DataFrame:
    """(head, word, salt, n): the longest gram from every word, as its first two
    words (then a line feed and the language) and the third; summed up in part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[str, _Stream] = {}
        known, held = pa.array(list(hot), pa.string()), 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                lang = lang.as_py()
                if lang not in streams:
                    streams[lang] = _Stream(lang)
                stream = streams[lang]
                words = text.as_py().encode("utf-8", "surrogatepass").translate(TABLE).replace(b".", b" . ").split()
                for at in range(0, len(words), SLICE):
                    stream.add(words[at:at + SLICE])
                    if len(stream.number) > NAMES - SLICE - 8:
                        yield from stream.grams(known, False)
                stream.add([b"."])
                held += len(words)
                if held > WINDOW:
                    for stream in streams.values():
                        yield from stream.grams(known, False)
                    held = 0
        for stream in streams.values():
            yield from stream.grams(known, True)

    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "head string, word string, salt int, n long")


def hot_pairs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[str, ...]:
    """Heads that start many grams, by a sample; at most 1 / HOT of them."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    found = grams(docs.sample(share, seed=7), text_col, lang_col).groupBy("head").agg(F.sum("n").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    return tuple(r["head"] for r in found.where(F.col("n") >= F.lit(total * HOT)).collect()) if total else ()


def edges(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``grams`` dealt so that all of a node (and salt) are in one partition."""
    return grams(docs, text_col, lang_col, hot_pairs(docs, text_col, lang_col)).repartition("head", "salt")


def _flows(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of a partition: frequent edges, the flow out of nodes, of words and of all."""
    keys, held, rows, limit = ["head", "salt", "word"], [], 0, 4_000_000

    def summed(tables: list[pa.Table], by: list[str]) -> pa.Table:
        return pa.concat_tables(tables).group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]).select([*keys, "n"]))
        rows += batch.num_rows
        if rows > limit:
            held = [summed(held, keys)]
            rows = held[0].num_rows
            limit = max(limit, 2 * rows)
    if not held:
        return
    edge = summed(held, keys)
    held.clear()
    often = edge.filter(pc.and_(pc.not_equal(edge["word"], ""), pc.greater_equal(edge["n"], min_count)))
    node = summed([edge], ["head", "salt"])
    del edge

    def parts(head: pa.ChunkedArray) -> tuple:
        both = pc.split_pattern(head, "\n", max_splits=1)
        return pc.list_element(both, 0), pc.list_element(both, 1)

    def out(lang, phrase, n) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"lang": lang, "phrase": phrase, "f": n}).combine_chunks().to_batches(max_chunksize=500_000)

    phrase, lang = parts(often["head"])
    yield from out(lang, pc.binary_join_element_wise(phrase, often["word"], " "), often["n"])
    phrase, lang = parts(node["head"])
    first = pc.list_element(pc.split_pattern(phrase, " ", max_splits=1), 0)
    # Of a salted node each part counts, of others only whole ones.
    pair = pc.and_(pc.not_equal(first, phrase), pc.or_(pc.greater_equal(node["n"], min_count), pc.greater(node["salt"], 0)))
    yield from out(lang.filter(pair), phrase.filter(pair), node["n"].filter(pair))
    words = summed([pa.table({"lang": lang, "phrase": first, "n": node["n"]})], ["lang", "phrase"])
    yield from out(words["lang"], words["phrase"], words["n"])
    every = summed([words.select(["lang", "n"])], ["lang"])
    yield from out(every["lang"], pa.chunked_array([pa.array([""] * len(every), pa.string())]), every["n"])


def _first(phrase: str | Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def _last(phrase: str | Column, words: int) -> Column:
    return F.substring_index(phrase, " ", -words)


def counts(dealt: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to 3 words with f >= min_count,
    and of the empty phrase, whose count is that of all words."""
    parts = dealt.mapInArrow(lambda batches: _flows(batches, min_count), "lang string, phrase string, f long")
    summed = parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("phrase") == ""))
    return stored(summed.select("lang", "phrase", F.regexp_count("phrase", F.lit(WORDS)).alias("words"), "f"), "phrases")


def graph(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (lang, phrase, f, most: weight of the strongest edge, inner) and
    edges (lang, phrase, f, source, target) of the frequent grams."""
    arcs = counted.where("words = 3").select("lang", "phrase", "f", _first("phrase", 2).alias("source"), _last("phrase", 2).alias("target"))
    sides = arcs.select("lang", F.col("source").alias("phrase"), F.col("f").alias("out"), F.lit(None).cast("long").alias("in_")).union(
        arcs.select("lang", "target", F.lit(None).cast("long"), "f"))
    nodes = counted.where("words = 2").select("lang", "phrase", "f", F.lit(None).cast("long").alias("out"), F.lit(None).cast("long").alias("in_")).union(
        sides.select("lang", "phrase", F.lit(None).cast("long"), "out", "in_"))
    met = nodes.groupBy("lang", "phrase").agg(F.max("f").alias("f"), F.max("out").alias("out"), F.max("in_").alias("in_"))
    inner = (F.col("out") == F.col("f")) & (F.col("in_") == F.col("f"))
    return stored(met.select("lang", "phrase", "f", F.greatest("out", "in_").alias("most"), F.coalesce(inner, F.lit(False)).alias("inner")), "nodes"), arcs


def paths(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(lang, phrase, f, source, target, head, place): every edge with the first edge of
    its unary path and its place there. Each round doubles how far pointers reach."""
    inner = nodes.where("inner").select("lang", F.col("phrase").alias("node"))
    ends = arcs.join(inner.withColumnRenamed("node", "source"), ["lang", "source"], "left_semi").select("lang", "phrase", "source")
    into = arcs.join(inner.withColumnRenamed("node", "target"), ["lang", "target"], "left_semi").select("lang", F.col("phrase").alias("head"), F.col("target").alias("source"))
    # An inner node has one edge in, which its edge out points to.
    links = stored(ends.join(into, ["lang", "source"]).select("lang", "phrase", "head", F.lit(1).cast("long").alias("place")), "links")
    while True:
        further = links.select("lang", F.col("phrase").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"))
        if links.join(further, ["lang", "head"], "left_semi").isEmpty():
            break
        links = stored(links.join(further, ["lang", "head"], "left").select(
            "lang", "phrase", F.coalesce("next", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "links")
    return arcs.join(links, ["lang", "phrase"], "left").select(
        "lang", "phrase", "f", "source", "target", F.coalesce("head", "phrase").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))


def compacted(placed: DataFrame) -> DataFrame:
    """Unary paths: lang, head (first edge), path_words, f. One row for each."""
    return placed.groupBy("lang", "head").agg((F.max("place") + 3).alias("path_words"), F.max("f").alias("f"))


def candidates(counted: DataFrame) -> DataFrame:
    """(lang, phrase, a, path_words, cuts): phrases that stay, with the shorter
    phrases that cuts give. A part that is an inner node has no name: its count is a."""
    nodes, arcs = graph(counted)
    placed = stored(paths(nodes, arcs), "paths")
    long_ = placed.join(compacted(placed).select("lang", "head", "path_words"), ["lang", "head"])
    at = nodes.select("lang", F.col("phrase").alias("node"), "inner")
    named = lambda inner, node: F.when(~F.col(inner), F.col(node))
    triples = (long_.join(at.select("lang", F.col("node").alias("source"), F.col("inner").alias("source_inner")), ["lang", "source"])
               .join(at.select("lang", F.col("node").alias("target"), F.col("inner").alias("target_inner")), ["lang", "target"])
               .select("lang", "phrase", F.col("f").alias("a"), "path_words", F.array(
                   F.struct(F.lit(1).alias("k"), _first("phrase", 1).alias("left"), named("target_inner", "target").alias("right")),
                   F.struct(F.lit(2).alias("k"), named("source_inner", "source").alias("left"), _last("phrase", 1).alias("right"))).alias("cuts")))
    pairs = nodes.where(F.coalesce(100 * F.col("most") < 50 * F.col("f"), F.lit(True))).select(
        "lang", "phrase", F.col("f").alias("a"), F.lit(2).cast("long").alias("path_words"),
        F.array(F.struct(F.lit(1).alias("k"), _first("phrase", 1).alias("left"), _last("phrase", 1).alias("right"))).alias("cuts"))
    return triples.union(pairs)


def scored(found: DataFrame, counted: DataFrame) -> DataFrame:
    """``candidates`` with a, l, r, score of their lowest-scoring cut."""
    f = lambda side: counted.where("words > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0]))
    cuts = found.select("lang", "phrase", "a", "path_words", F.explode("cuts").alias("cut")).select("lang", "phrase", "a", "path_words", "cut.*")
    met = cuts.join(f("left"), ["lang", "left"], "left").join(f("right"), ["lang", "right"], "left").select(
        "lang", "phrase", "a", "path_words", "k", F.coalesce("l", "a").alias("l"), F.coalesce("r", "a").alias("r"))
    score = F.expr("CAST(1000000 AS DECIMAL(38,0)) * a * a DIV (CAST(l AS DECIMAL(38,0)) * r)")
    least = met.groupBy("lang", "phrase", "a", "path_words").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "path_words", "cut.l", "cut.r", "cut.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt, parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), PARTS
    while True:
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        if parts == 1:
            return dealt.drop("part").withColumn("rank", F.col("rank").cast("long"))
        parts //= FAN_IN
        dealt = dealt.drop("rank").withColumn("part", F.pmod("part", F.lit(parts)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words) of each language's first ``top`` phrases."""
    counted = counts(edges(docs, text_col, lang_col), min_count)
    best = ranked(scored(candidates(counted), counted), top)
    words = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


def op12_phrases(spark, sf_dir):
    return collocations(load(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PIECE_END}')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '{WORDS}') AS ws FROM p
), g AS (
  SELECT lang, unnest(flatten([list_transform(range(1, len(ws) + 2 - k), lambda i: array_to_string(ws[i:i + k - 1], ' ')) FOR k IN [1, 2, 3]])) AS phrase FROM w
), f AS (
  SELECT lang, phrase, len(string_split(phrase, ' ')) AS words, count(*) AS f FROM g GROUP BY lang, phrase
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE f >= {MIN_COUNT} AND words > 1
), e AS (
  SELECT lang, phrase, f, array_to_string(ws[1:2], ' ') AS source, array_to_string(ws[2:3], ' ') AS target FROM c WHERE words = 3
), o AS (SELECT lang, source AS phrase, max(f) AS most FROM e GROUP BY ALL
), i AS (SELECT lang, target AS phrase, max(f) AS most FROM e GROUP BY ALL
), inner_ AS (
  SELECT c.lang, c.phrase FROM c JOIN o ON c.lang = o.lang AND c.phrase = o.phrase AND c.f = o.most JOIN i ON c.lang = i.lang AND c.phrase = i.phrase AND c.f = i.most
), walk AS (
  SELECT lang, phrase AS head, phrase, target, 3 AS words FROM e WHERE (lang, source) NOT IN (SELECT (lang, phrase) FROM inner_)
  UNION ALL
  SELECT walk.lang, walk.head, e.phrase, e.target, walk.words + 1
  FROM walk JOIN inner_ ON walk.lang = inner_.lang AND walk.target = inner_.phrase JOIN e ON e.lang = walk.lang AND e.source = walk.target
), len_ AS (
  SELECT lang, phrase, CAST(max(words) OVER (PARTITION BY lang, head) AS BIGINT) AS path_words FROM walk
), s AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), t AS (
  SELECT b.* FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c x WHERE x.lang = b.lang AND x.words > b.words AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.f >= 50 * b.a)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t
)
SELECT lang, rank, phrase, a, l, r, n, score, coalesce(path_words, 2) AS path_words
FROM k JOIN n USING (lang) LEFT JOIN len_ USING (lang, phrase) WHERE rank <= {TOP}
"""
QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {"op12_phrases": SQL}
