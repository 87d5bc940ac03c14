"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents (by a digest of the id) and may run through
them up to ``epochs`` times. The copy of a document gets a virtual finish time:
words of its source up to and including it, divided by the weight of the
source. All copies are range-sorted by finish time and the sequence is cut
where its words reach the budget, here the words of all sources. A source
that runs out leaves its share to the others, in proportion to their weights,
so the words taken follow the targets (``source_targets``) to within one
document a source.

Nothing gathers a source in one task: a source is dealt into slices of about
``slice_rows`` rows by digest, slices give prefix sums, and rows are summed
within their slice. The global sequence is range-partitioned, so that what
comes before a partition is a sum over partitions. Only the totals of slices
and partitions and one row per source meet in one task.

Defined results: null or empty texts have no words, are taken 0 times and do
not count. A null source is a source, after all others. Repeated ids share a
digest; ties go by id, size and row content. No words at all: nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, load, stored, texts

EPOCHS = 3
SLICE_ROWS = 4096


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, shuffle) of every document; ``shuffle`` is its place's digest."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return stored(slim.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle")), "sizes")


def source_targets(sized: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, weight, source_size, target.

    Weights are 1, 2, 3, repeating, by code point order. Filling up: with the
    sources by epochs * size / weight, those before the first one whose limit
    the level reaches stop at their limit, the others get weight times level.
    The level left to the others rises over the sources that stop and falls
    after them, so the right one is the highest that its source can take.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.select("*", ((F.row_number().over(order) - 1) % 3 + 1).cast("double").alias("weight"))
    limit = F.col("source_size") * epochs
    everything = Window.partitionBy()
    before = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*", limit.cast("double").alias("limit"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).cast("double")
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    level = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return levels.select("source", "weight", "source_size", target.alias("target"))


def _slices(sized: DataFrame, slice_rows: int) -> DataFrame:
    """``sized`` with ``done``: words of its source up to and including the row."""
    n = max(1, -(-sized.count() // slice_rows))
    sliced = sized.select("*", (F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * n / 2**32).cast("long").alias("slice"))
    per_slice = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "slice").orderBy("shuffle", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    return (sliced.select("*", F.sum("size").over(within).alias("inside"))
            .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
            .select("row", "doc_id", "source", "size", "shuffle", (F.col("inside") + F.col("offset")).alias("done")))


def schedule(sized: DataFrame, epochs: int = EPOCHS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All copies that the mix takes: row, doc_id, source, size, copy, finish
    (virtual time), words_before. Rows come range-sorted by finish time."""
    targets = stored(source_targets(sized, epochs), "targets")
    placed = _slices(sized.where("size > 0"), slice_rows)
    t = targets.select(F.col("source").alias("s"), "weight", "source_size")
    copies = (placed.join(F.broadcast(t) if _few(targets) else t, F.col("source").eqNullSafe(F.col("s")))
              .select("row", "doc_id", "source", "size", "shuffle", "weight",
                      F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("copy"), "done", "source_size")
              .select("row", "doc_id", "source", "size", "shuffle", "copy",
                      ((F.col("copy") * F.col("source_size") + F.col("done")) / F.col("weight")).alias("finish")))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("shuffle"), F.col("doc_id"), F.col("size"), F.col("row"), F.col("copy")]
    dealt = stored(stored(copies, "copies").repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()), "sequence").withColumn("part", F.shiftright("at", 33))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    # The words before each partition; those beyond the budget are not read again.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.sum("size").alias("words")).select("part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(offsets.where(F.col("offset") < budget), "part")
            .select("*", (F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("offset")).alias("words_before"))
            .where(F.col("words_before") + F.col("size") <= budget)
            .select("row", "doc_id", "source", "size", "copy", "finish", "words_before"))


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the sources are few enough to broadcast (under 1 MB)."""
    return targets.count() <= most


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS) -> DataFrame:
    """The mixed sequence of ``schedule``, range-sorted by finish time."""
    return schedule(sizes(docs, id_col, text_col, source_col), epochs).orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "copy")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with all their columns."""
    sized = sizes(docs, id_col, text_col, source_col)
    taken = schedule(sized).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("d"), F.col(source_col).cast("string").alias("s"), F.col(text_col).alias("text_"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("z"))
    found = keyed.join(taken, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")))
    # Rows that agree in id, source and size share what was taken of them.
    alike = Window.partitionBy("d", "s", "z")
    rows, k = F.count("*").over(alike), F.row_number().over(alike.orderBy(F.md5(F.col("text_").cast("string"))))
    own = found.select("doc", (F.floor(F.col("times") / rows) + (k <= F.col("times") % rows).cast("long")).cast("int").alias("own"))
    return own.where("own > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("own")))).select("doc.*")


def op9_mix_sources(spark, sf_dir):
    sized = sizes(load(spark, sf_dir, "documents"))
    targets = source_targets(sized).select(F.col("source").alias("s"), "source_size", "target")
    taken = schedule(sized).groupBy("row").agg(F.sum("size").alias("taken"))
    rows = sized.join(taken, "row", "left")
    few = F.broadcast(targets) if _few(targets) else targets
    return rows.join(few, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents
), w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS lim,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, weight,
         least(lim, weight * coalesce(max(CASE WHEN level <= lim / weight THEN level END) OVER (), 'infinity'::DOUBLE)) AS target
  FROM l
), c AS (
  SELECT d.row, d.doc_id, d.source, d.size, d.shuffle, e.copy,
         (e.copy * t.source_size
          + sum(d.size) OVER (PARTITION BY d.source, e.copy ORDER BY d.shuffle, d.doc_id, d.size, d.row ROWS UNBOUNDED PRECEDING)) / t.weight AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS copy) e
  WHERE d.size > 0
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, shuffle, doc_id, size, row, copy ROWS UNBOUNDED PRECEDING) AS words FROM c
), k AS (
  SELECT row, sum(size) AS taken FROM g WHERE words <= (SELECT sum(source_size) FROM t) GROUP BY row
)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (row)
"""
QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES = {"op9_mix_sources": SQL}
