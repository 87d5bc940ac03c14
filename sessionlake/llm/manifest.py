"""Merkle manifest of a data set, built as a rollup of nested structs.

Each document is a leaf. Leaves are ranked within their source; the rank's
digits to base 16 say where in the tree a leaf stands. A bounded block holds
the leaves that agree in all but the last ``DIGITS`` digits. Within it the
digits are grouped away one after the other: a run of at most 16 children
becomes an array of structs, its digest a field of the struct one level up. So
one row of a block holds the whole subtree of at most 256 leaves. The digests
of blocks are ranked nodes again, and are rolled up alike, until one is left:
the source's root. The roots of the sources are rolled up the same way.

Going back, the row of a block meets the levels above it by grouping (a union,
no join), and exploding its runs gives each child its siblings, level by level,
up to the root. ``folded`` recomputes a root from a leaf and its siblings.

Nothing gathers a source: a source is spread by ranges of ids, a block has at
most 256 leaves, each round makes 256 nodes one, and only the counts of
partitions meet in one task. Equal rows are told apart by row numbers, so that
many copies of a row are spread too.

Defined results: nulls are ``-`` in a leaf; null sources and ids come first.
Rows that agree in source and id go by digest; equal rows have equal leaves,
each with its own place. A leaf alone in its source is the source's root, a
source alone the root. An empty table gives an empty manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, stored

FAN_OUT = 16
#: Digits of a rank that are grouped away within one block.
DIGITS = 2
BLOCK = FAN_OUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = "array<struct<left:string,right:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its length in bytes, a colon and itself."""
    framed = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*framed), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", other: dict[str, Column] | None = None) -> DataFrame:
    """(row, source, doc_id, leaf, *other) of every document, without the text."""
    return stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(group_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"), *[c.alias(name) for name, c in (other or {}).items()]), "leaves")


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``size`` within the groups of ``by``.

    Range-sorted rows are numbered within their partitions; what partitions
    before hold of the same group is added.
    """
    keys = [F.col(c).asc_nulls_first() for c in by + order]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy(*by, part).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("part").alias("of_part"), "start",
                       F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("size"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"of_{c}")), by, part == F.col("of_part"))
    return placed.join(runs, same).select(*rows.columns, (F.col("at") - F.col("start") + F.col("before")).alias("rank"), "size")


def _node(run: str, count: Column) -> Column:
    """The digest of a run, where its level has several nodes; a node alone is its own parent."""
    return F.when(count > 1, F.sha2(F.array_join(F.col(f"{run}.digest"), ""), 256)).otherwise(F.col(run)[0]["digest"])


def rolled_up(nodes: DataFrame, by: list[str], held: list[str]) -> DataFrame:
    """Blocks of ``nodes`` (by, rank, size, digest, held): by, rank, size, digest,
    below (nodes under it) and ``runs``, the nested subtree with ``held`` at its leaves."""
    digit = lambda k: F.pmod(F.floor(F.col("rank") / FAN_OUT**k), F.lit(FAN_OUT)).cast("int")
    dealt = nodes.select(*by, F.floor(F.col("rank") / BLOCK).alias("block"), "size", digit(1).alias("d1"),
                         F.struct(digit(0).alias("d"), "digest", *held).alias("child"))
    above = F.ceil(F.col("size") / FAN_OUT)
    return (dealt.repartition(*by, "block")
            .groupBy(*by, "block", "size", "d1").agg(F.array_sort(F.collect_list("child"), lambda a, b: a["d"] - b["d"]).alias("run"))
            .select(*by, "block", "size", F.struct(F.col("d1").alias("d"), _node("run", F.col("size")).alias("digest"), "run").alias("child"))
            .groupBy(*by, "block", "size").agg(F.array_sort(F.collect_list("child"), lambda a, b: a["d"] - b["d"]).alias("runs"))
            .select(*by, F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), _node("runs", above).alias("digest"),
                    F.col("size").alias("below"), "runs"))


def towers(nodes: DataFrame, by: list[str], held: list[str]) -> list[DataFrame]:
    """All levels of blocks, from the lowest up to those that are alone."""
    levels = [stored(rolled_up(nodes, by, held), "blocks")]
    while (levels[-1].agg(F.max("size")).first()[0] or 0) > 1:
        levels.append(stored(rolled_up(levels[-1].select(*by, "rank", "size", "digest"), by, []), "blocks"))
    return levels


def opened(blocks: DataFrame, above: DataFrame, by: list[str], held: list[str]) -> DataFrame:
    """The children of ``blocks``: by, rank, digest, held, ``top`` and ``levels``
    up to the root, given those of the blocks (by, rank, top, levels)."""
    met = (blocks.select(*by, "rank", "below", "runs", F.lit(None).cast(above.schema["up"].dataType).alias("up"))
           .unionByName(above.select(*by, "rank", "up"), allowMissingColumns=True)
           .groupBy(*by, "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("below", "runs", "up")]))
    siblings = lambda all_, i: F.struct(
        F.array_join(F.slice(all_, F.lit(1), i), "").alias("left"), F.array_join(F.slice(all_, i + 2, F.lit(FAN_OUT)), "").alias("right"))
    level = lambda applies, all_, i: F.when(applies, F.array(siblings(all_, i))).otherwise(F.array().cast(LEVELS))
    runs = met.select(*by, "rank", "below", "up", F.col("runs.digest").alias("upper"), F.posexplode("runs").alias("i", "run"))
    children = runs.select(*by, "rank", "below", "up", "upper", "i", "run.d", F.col("run.run.digest").alias("lower"), F.posexplode("run.run").alias("j", "child"))
    return children.select(
        *by, (F.col("rank") * BLOCK + F.col("d") * FAN_OUT + F.col("child.d")).alias("rank"), "child.digest", *[F.col(f"child.{c}") for c in held],
        F.struct("up.top", F.concat(level(F.col("below") > 1, F.col("lower"), F.col("j")), level(F.col("below") > FAN_OUT, F.col("upper"), F.col("i")),
                                    F.col("up.levels")).alias("levels")).alias("up"))


def proofs(leaf_rows: DataFrame, held: tuple[str, ...] = ()) -> DataFrame:
    """(source, doc_id, *held, leaf, subroot, root, levels) of all ``leaves``."""
    kept = ["doc_id", *held]
    nodes = ranked(leaf_rows, ["source"], ["doc_id", "leaf", "row"]).select("source", "rank", "size", F.col("leaf").alias("digest"), *kept)
    low = towers(nodes, ["source"], kept)
    subroots = low[-1].select("source", "digest")
    high = towers(ranked(subroots, [], ["source"]), [], ["source"])
    # From the root down: top is (subroot, root), the subroot as soon as it is known.
    up = lambda subroot, root, levels: F.struct(F.struct(subroot.alias("subroot"), root.alias("root")).alias("top"), levels.alias("levels")).alias("up")
    down = high[-1].select("rank", up(F.lit(None).cast("string"), F.col("digest"), F.array().cast(LEVELS)))
    for blocks in reversed(high[1:]):
        down = opened(blocks, down, [], [])
    down = opened(high[0], down, [], ["source"]).select("source", F.lit(0).cast("long").alias("rank"), up(F.col("digest"), F.col("up.top.root"), F.col("up.levels")))
    for blocks in reversed(low[1:]):
        down = opened(blocks, down, ["source"], [])
    return opened(low[0], down, ["source"], kept).select(
        "source", *kept, F.col("digest").alias("leaf"), "up.top.subroot", "up.top.root", "up.levels")


def folded(leaf: Column, levels: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(levels, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_digest(levels: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(levels, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """(source, doc_id, leaf, subroot, root, levels) of every document."""
    return proofs(leaves(docs, fields, id_col, group_col))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_manifest(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(*FIELDS)
    lowered = leaf_digest([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered)
    found = proofs(leaves(docs, other={"tampered": tampered}), ("tampered",))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("levels")).alias("proof_sha256"),
                        folded(F.coalesce("tampered", "leaf"), F.col("levels")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the statement goes up within a source and over sources: 16 to that power of nodes at most.
SQL_LEVELS = 5


def _sql() -> str:
    frame = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(crc, code), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, code: {step}), 4294967295)"
    parts = [f"""
WITH a0 AS (
  SELECT doc_id, source, sha256({" || ".join(map(frame, FIELDS))}) AS h,
         CASE WHEN {crc} % 5 = 0 THEN sha256({" || ".join([frame(c) for c in FIELDS[:-1]] + [frame(lower)])}) END AS tampered
  FROM documents
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM a0
), n0 AS (SELECT source, r, h, count(*) OVER (PARTITION BY source) AS n FROM leaf)"""]

    def up(name, k, key):
        lift = f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END"
        cols = f"{key}, " if key else ""
        size = f"count(*) OVER (PARTITION BY {key})" if key else "count(*) OVER ()"
        parts.append(f""", {name}{k + 1} AS (
  SELECT *, {size} AS n FROM (SELECT {cols}r // 16 AS r, {lift} AS h FROM {name}{k} GROUP BY {cols}r // 16)
)""")

    for k in range(SQL_LEVELS):
        up("n", k, "source")
    parts.append(f""", s0 AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM n{SQL_LEVELS}
)""")
    for k in range(SQL_LEVELS):
        up("s", k, "")
    # The siblings of every leaf, and its digest folded upwards.
    parts.append(", f0 AS (SELECT l.doc_id, l.source, l.r, l.h AS leaf, '' AS proof, coalesce(l.tampered, l.h) AS cur FROM leaf l)")

    def fold(name, k, out, key):
        same = f"f.source IS NOT DISTINCT FROM x.{key} AND " if key else ""
        cols = f"{key}, " if key else ""
        parts.append(f""", f{out} AS (
  SELECT f.* EXCLUDE (r, proof, cur), f.r // 16 AS r,
         CASE WHEN x.n > 1 THEN f.proof || array_to_string(list_transform(list_filter(x.kids, lambda e: e.r <> f.r), lambda e: e.h), '') ELSE f.proof END AS proof,
         CASE WHEN x.n > 1 THEN sha256(array_to_string(list_transform(x.kids, lambda e: CASE WHEN e.r = f.r THEN f.cur ELSE e.h END), '')) ELSE f.cur END AS cur
  FROM f{out - 1} f JOIN (SELECT {cols}r // 16 AS q, any_value(n) AS n, list({{'r': r, 'h': h}} ORDER BY r) AS kids FROM {name}{k} GROUP BY {cols}r // 16) x
    ON {same}f.r // 16 = x.q
)""")

    for k in range(SQL_LEVELS):
        fold("n", k, k + 1, "source")
    parts.append(f""", g AS (
  SELECT f.* EXCLUDE (r), s.r, s.h AS subroot FROM f{SQL_LEVELS} f JOIN s0 s ON f.source IS NOT DISTINCT FROM s.source
), f{SQL_LEVELS + 1} AS (SELECT * FROM g)""")
    for k in range(SQL_LEVELS):
        fold("s", k, SQL_LEVELS + 2 + k, "")
    parts.append(f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM f{2 * SQL_LEVELS + 1}, (SELECT h AS root FROM s{SQL_LEVELS})
""")
    return "".join(parts)


SQL = _sql()
QUERIES = {"op13_manifest": op13_manifest}
ORACLES = {"op13_manifest": SQL}
