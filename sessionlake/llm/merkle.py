"""Document fingerprints: a Merkle tree over paragraphs and sections.

A section is a line with its line feed. It consists of paragraphs: runs that
end at a sentence end or after ``PARAGRAPH`` code points. A leaf is the SHA-256
of a paragraph, a branch that of its leaves' digests, the root that of the
branches' digests. The fingerprint is text, ``root:section;section;...``, where
a section is the first 8 digits of its branch and of each leaf. Roots tell
whether texts are equal; branches and leaves that differ tell where they differ
(``changed``); the share of common leaves is the likeness.

The document after a document, by descending id, is found on ids alone: they
are range-partitioned and sorted, and only the ends of partitions meet. Texts
are shuffled once, plus the heads that documents lend their predecessors.

Defined results: a null text is empty; an empty text has no section, and the
likeness of two empty ones is 1. A null id comes last. Rows that repeat an id
each have the next different id's text; of several texts of that id the least.
A single document follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, stored, texts

PARAGRAPH = 48
SECTION = r"[^\n]*\n|[^\n]+"
PIECE = rf"[^.!?]{{1,{PARAGRAPH}}}[.!?]*[ \t\n\x0B\f\r]*|[.!?]+[ \t\n\x0B\f\r]*"


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text, as text."""
    sections = F.transform(
        F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)),
        lambda s: F.transform(F.regexp_extract_all(s, F.lit(PIECE), F.lit(0)), lambda p: F.sha2(p, 256)))
    branches = F.transform(sections, lambda leaves: F.struct(
        F.sha2(F.array_join(leaves, ""), 256).alias("digest"),
        F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, 8)), "").alias("leaves")))
    return F.concat(
        F.sha2(F.array_join(F.transform(branches, lambda b: b["digest"]), ""), 256), F.lit(":"),
        F.array_join(F.transform(branches, lambda b: F.concat(F.substring(b["digest"], 1, 8), b["leaves"])), ";"))


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def _sections(print_: Column) -> Column:
    return F.filter(F.split(F.substring_index(print_, ":", -1), ";"), lambda s: s != "")


def _leaves(print_: Column) -> Column:
    packed = F.array_join(F.transform(_sections(print_), lambda s: F.substring(s, 9, 2**31 - 1)), "")
    return F.array_distinct(F.regexp_extract_all(packed, F.lit(".{8}"), F.lit(0)))


def likeness(left: Column, right: Column) -> Column:
    """1 for equal roots, otherwise less: twice the common distinct leaves by all of both."""
    def measured(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = (F.size(a) + F.size(b)).cast("double")
        return F.least(F.size(F.array_intersect(a, b)) * 2.0 / n, 1.0 - 1.0 / (n + 1.0))
    # A one-element array binds the leaves to a name, so they are taken apart once.
    found = F.transform(F.array(F.struct(_leaves(left).alias("a"), _leaves(right).alias("b"))), measured)
    return F.when(root(left) == root(right), F.lit(1.0)).otherwise(F.element_at(found, 1))


def changed(left: Column, right: Column) -> Column:
    """Where two texts differ: (section, paragraphs) by number from 0.

    Sections are aligned by their branches: those that agree from the start and
    from the end are passed over, so a section put in moves none of the others.
    What lies between is compared in turn; equal branches are not looked into.
    """
    branch = lambda s: F.substring(s, 1, 8)
    # Without a difference the place is 0, and all of the shorter one agree.
    agree = lambda x, y, most: F.least(most, F.coalesce(F.nullif(F.array_position(
        F.transform(F.arrays_zip(x.alias("a"), y.alias("b")), lambda z: branch(z["a"]).eqNullSafe(branch(z["b"]))), F.lit(False)), F.lit(0)) - 1, most)).cast("int")

    def leaf_diff(pair: Column) -> Column:
        cut = lambda s: F.regexp_extract_all(F.substring(F.coalesce(s, F.lit("")), 9, 2**31 - 1), F.lit(".{8}"), F.lit(0))
        both = F.arrays_zip(cut(pair["a"]).alias("a"), cut(pair["b"]).alias("b"))
        numbered = F.transform(both, lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i))
        return F.filter(numbered, lambda i: i.isNotNull())

    def between(x: Column) -> Column:
        inside = lambda c: F.slice(x[c], x["start"] + 1, F.size(x[c]) - x["start"] - x["end"])
        marked = F.transform(F.arrays_zip(inside("a").alias("a"), inside("b").alias("b")), lambda z, i: F.when(
            ~branch(z["a"]).eqNullSafe(branch(z["b"])), F.struct((i + x["start"]).alias("section"), leaf_diff(z).alias("paragraphs"))))
        return F.filter(marked, lambda z: z.isNotNull())

    # One-element arrays bind what is used several times to names.
    both = F.array(F.struct(_sections(left).alias("a"), _sections(right).alias("b")))
    started = F.transform(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), agree(x["a"], x["b"], F.least(F.size(x["a"]), F.size(x["b"]))).alias("start")))
    ended = F.transform(started, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["start"].alias("start"), agree(
        F.reverse(x["a"]), F.reverse(x["b"]), F.least(F.size(x["a"]), F.size(x["b"])) - x["start"]).alias("end")))
    return F.element_at(F.transform(ended, between), 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, print) of every document."""
    return texts(docs, id_col, text_col).withColumn("print", fingerprint(F.col("text")))


def followers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, before, wanted): every distinct id, the id it follows by descending
    id, and how many code points that one wants of it. Ids are (none, id) pairs."""
    ids = texts(docs, id_col, text_col).select(_key("doc_id").alias("key"), F.char_length("text").alias("n")).groupBy("key").agg(F.max("n").alias("n"))
    order = [F.col("key.none").asc(), F.col("key.id").desc()]
    placed = stored(ids.repartitionByRange(*order).select("key", "n", F.spark_partition_id().alias("part")), "ids")
    within = Window.partitionBy("part").orderBy(*order)
    rows = placed.select("*", F.row_number().over(within).alias("k"), F.lag(F.struct("key", "n")).over(within).alias("before"))
    # The first id of a partition follows the last one of the partition before; the very first one follows the last of all.
    backwards = Window.partitionBy("part").orderBy(F.col("key.none").desc(), F.col("key.id").asc())
    ends = placed.select("part", F.struct("key", "n").alias("end"), F.row_number().over(backwards).alias("r")).where("r = 1")
    by_part = Window.orderBy("part")
    ends = ends.select(F.col("part").alias("p"), F.coalesce(
        F.lag("end").over(by_part), F.last("end").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    return (rows.join(ends, F.col("part") == F.col("p"))
            .select("key", F.coalesce("before", F.when(F.col("k") == 1, F.col("end"))).alias("before"))
            .select("key", F.col("before.key").alias("before"), F.floor(F.col("before.n") / 3).cast("int").alias("wanted")))


def _key(name: str) -> Column:
    return F.struct(F.col(name).isNull().alias("none"), F.coalesce(F.col(name).cast("long"), F.lit(0)).alias("id"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprints`` with ``head`` (what the next document lends) and ``next_print``."""
    # Both joins read (key, text) alone, so that the texts are shuffled once;
    # fingerprints are made after the shuffle, where they need not be moved.
    base = texts(docs, id_col, text_col).select(_key("doc_id").alias("key"), "text")
    links = stored(followers(docs, id_col, text_col), "followers")
    lent = (base.join(links, "key")
            .select(F.col("before").alias("key"), F.struct(F.expr("left(text, wanted)").alias("head"), fingerprint(F.col("text")).alias("next_print")).alias("lent"))
            .groupBy("key").agg(F.min("lent").alias("lent")))
    return base.join(lent, "key").select(
        F.when(~F.col("key.none"), F.col("key.id")).alias("doc_id"), "text", fingerprint(F.col("text")).alias("print"), "lent.head", "lent.next_print")


def op4_fingerprints(spark, sf_dir):
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(load(spark, sf_dir, "documents")).select(
        "doc_id", "print", "next_print", n.cast("long").alias("n_chars"),
        F.concat(F.left("text", n - third), F.left("head", third)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), "edited_fingerprint",
        likeness(F.col("print"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))


def _sql_print(text: str) -> str:
    leaves = f"list_transform(regexp_extract_all({text}, '{SECTION}'), lambda s: list_transform(regexp_extract_all(s, '{PIECE}'), lambda p: sha256(p)))"
    branches = f"list_transform({leaves}, lambda v: {{'d': sha256(array_to_string(v, '')), 'l': array_to_string(list_transform(v, lambda x: x[1:8]), '')}})"
    return (f"list_transform([{branches}], lambda b: sha256(array_to_string(list_transform(b, lambda x: x.d), '')) || ':' || "
            f"array_to_string(list_transform(b, lambda x: x.d[1:8] || x.l), ';'))[1]")


def _sql_like(a: str, b: str) -> str:
    leaves = lambda p: f"list_distinct(regexp_extract_all(regexp_replace({p}[66:], '(^|;)[0-9a-f]{{8}}', '', 'g'), '.{{8}}'))"
    n = f"CAST(len({leaves(a)}) + len({leaves(b)}) AS DOUBLE)"
    return (f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0::DOUBLE ELSE "
            f"least(len(list_intersect({leaves(a)}, {leaves(b)})) * 2.0::DOUBLE / {n}, 1.0::DOUBLE - 1.0::DOUBLE / ({n} + 1.0::DOUBLE)) END")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d
), x AS (
  SELECT doc_id, n, text, nxt, left(text, n - n // 3) || left(nxt, n // 3) AS edited FROM e
), f AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_sql_print("text")} AS fp, {_sql_print("edited")} AS ep, {_sql_print("nxt")} AS np FROM x
)
SELECT doc_id, n AS n_chars, edited_sha256, fp AS fingerprint, ep AS edited_fingerprint,
       {_sql_like("fp", "ep")} AS near_edited, {_sql_like("fp", "np")} AS near_next
FROM f
"""
QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLES = {"op4_fingerprints": SQL}
