"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of at most ``counters`` digests find all that have more
than 1/(counters+1) of the rows. They are made block by block and merged in
rounds: counts are added up, and what stands at place counters+1 is taken from
all. The groups they name are counted exactly; those that are frequent indeed
are broadcast (at most ``counters`` rows of about 100 bytes), so that rows of
these groups are decided map-side and never shuffled. The rows of all other
digests take the ordinary shuffle, where none has more than a small share.

Defined results: a null text is an empty text; all texts of white space only
are equal to it. Null ids come after all others. Of rows that agree in
everything exactly one is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, stored, stripped, texts

COUNTERS = 1024
#: Rows of a block; blocks merge by so many at a time.
BLOCK_ROWS, FAN_IN = 65_536, 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_chars, digest) of every document, without the text."""
    return stored(
        texts(docs, id_col, text_col).select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(stripped(F.col("text")), 256)).alias("digest"),
        ),
        "digests",
    )


def _best() -> Column:
    """Orders the rows of a group: the least one stays."""
    return F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size"))


def misra_gries(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, count): lower bounds for at most ``counters`` digests, among them
    each that has more than 1/(counters+1) of the rows."""
    blocks = -(-rows.count() // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))
    summary = _summed(rows.select(block.alias("block"), "digest", F.lit(1).cast("long").alias("n")), counters)
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        summary = _summed(summary.withColumn("block", F.floor(F.col("block") / FAN_IN)), counters)
    return summary.select("digest", F.col("n").alias("count"))


def _summed(counts: DataFrame, counters: int) -> DataFrame:
    summed = counts.groupBy("block", "digest").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("block").orderBy(F.col("n").desc(), "digest")
    ranked = summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= counters + 1)
    cut = F.max(F.when(F.col("place") == counters + 1, F.col("n"))).over(Window.partitionBy("block"))
    return ranked.select("block", "digest", (F.col("n") - F.coalesce(cut, F.lit(0))).alias("n")).where("n > 0")


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The verified winners: digest, best row and exact size of the groups that
    hold more than 1/counters of the rows."""
    candidates = misra_gries(rows, counters).select("digest")
    counted = _groups(rows.join(F.broadcast(candidates), "digest", "left_semi"))
    total = rows.count()
    return stored(counted.where((F.col("group_size") > 1) & (F.col("group_size") * counters > total)), "winners")


def groups_of_rows(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, digest."""
    heavy = frequent(rows, counters)
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    columns = ["row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
               (F.col("row") == F.col("best.row")).alias("kept"), "digest", "n_chars"]
    hot = marked.where(F.col("best").isNotNull()).select(*columns)
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    w = Window.partitionBy("digest")
    cold = rest.select("*", F.min(_best()).over(w).alias("best"), F.count("*").over(w).alias("group_size")).select(*columns)
    return hot.unionByName(cold)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The group of every document and the row that stays in it."""
    return groups_of_rows(digests(docs, id_col, text_col), counters)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The join back is by (digest, id, length), so that a large group of copies is
    spread over all tasks; rows that agree in all three meet there.
    """
    names = docs.columns
    kept = exact_groups(docs, id_col, text_col).where("kept").select(
        F.struct("digest", "doc_id", "n_chars").alias("key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        F.struct(F.unhex(F.sha2(stripped(text), 256)).alias("digest"), F.col(id_col).alias("doc_id"),
                 F.char_length(text).cast("long").alias("n_chars")).alias("key"))
    return keyed.join(kept, "key").dropDuplicates(["key"]).select("doc.*")


def op7_exact_dedup(spark, sf_dir):
    return exact_groups(load(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": SQL}
