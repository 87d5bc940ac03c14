"""Content identity: session digests, summaries, duplicates, validation, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions import hashing, text as tx
from sessionlake.operators.positions import RUN_LENGTH


def content_hash(
    messages: DataFrame, keys: list[str], position: str = "pos", digest: str = "msg_digest"
) -> DataFrame:
    """Ordered digest of every session, as a tree of bounded groups.

    Messages are digested in runs of 4096 consecutive positions and the run
    digests once more, so the largest value ever assembled for a session of n
    messages is n/64 bytes.  Equal sequences have equal digests, whatever
    their ids, times or paths.
    """
    return hash_of_runs(run_digests(messages, keys, position, digest), keys)


def run_digests(
    messages: DataFrame, keys: list[str], position: str = "pos", digest: str = "msg_digest", length: int = RUN_LENGTH
) -> DataFrame:
    """Lower level of the digest tree: ``keys, run, run_digest, run_messages, run_first`` (least position).

    Kept as a table, it hashes sessions and tells where two of them differ
    without looking at messages.
    """
    return messages.groupBy(*keys, F.floor(F.col(position) / length).alias("run")).agg(
        _ordered_digest(position, digest, "").alias("run_digest"), F.count("*").alias("run_messages"),
        F.min(position).alias("run_first"),
    )


def hash_of_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Upper level of the digest tree."""
    return runs.groupBy(*keys).agg(
        F.concat(F.lit("sha256:"), _ordered_digest("run", "run_digest", fv.HASH_PREFIX)).alias("content_hash"),
        F.sum("run_messages").alias("message_count"),
    )


def _ordered_digest(order: str, digest: str, prefix: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order, digest)))
    return F.sha2(
        F.concat(F.lit(prefix), F.array_join(F.transform(ordered, lambda x: x[digest]), "")), 256
    )


def time_bounds(messages: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """First and last timestamp of each session, compared as instants."""
    instant = tx.parse_instant(F.col(ts))
    return messages.groupBy(*keys).agg(F.min(instant).alias("first_at"), F.max(instant).alias("last_at"))


def fill_times(sessions: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Created and updated times, taken from the messages where absent."""
    return (
        sessions.join(bounds, keys, "left")
        .withColumn("created_at", F.coalesce("created_at", "first_at"))
        .withColumn("updated_at", F.coalesce("updated_at", "last_at"))
        .drop("first_at", "last_at")
    )


def summarize(messages: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Message count, count per role, characters of text, first user text."""
    said = (F.col("role") == "user") & (F.col("text") != "")
    counts = [F.count_if(F.col("role") == r).alias(f"{r}_count") for r in fv.ROLES]
    return messages.groupBy(*keys).agg(
        F.count("*").alias("message_count"),
        *counts,
        F.coalesce(F.sum(tx.utf16_length(F.col("text"))), F.lit(0)).alias("text_chars"),
        # The clipped text travels, not the text.
        F.min(F.when(said, F.struct(F.col(position), F.substring("text", 1, fv.CLIP_SUMMARY).alias("t"))))["t"]
        .alias("first_user_text"),
    )


def copies(items: DataFrame, item: str, holder: str, digest: str = "content_hash") -> DataFrame:
    """One row per content: how many items and holders have it, and the first.

    Members are not collected; join back on the digest to list them.
    """
    per_holder = items.groupBy(digest, holder).agg(F.count("*").alias("_n"), F.min(item).alias("_first"))
    return per_holder.groupBy(digest).agg(
        F.sum("_n").alias("copies"),
        F.count("*").alias("holders"),
        F.min("_first").alias("first_item"),
    )


def duplicates(items: DataFrame, item: str, holder: str, digest: str = "content_hash") -> DataFrame:
    return copies(items, item, holder, digest).where("copies > 1")


def message_problems(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages whose role or type is outside the vocabulary, one row each."""
    bad_role = ~F.coalesce(F.col("role").isin(*fv.ROLES), F.lit(False))
    bad_type = ~F.coalesce(F.col("type").isin(*fv.MESSAGE_TYPES), F.lit(False))
    found = F.array_compact(F.array(F.when(bad_role, "role"), F.when(bad_type, "type")))
    return messages.select(
        *keys, F.explode(found).alias("field"), F.col("pos").cast("long").alias("position")
    )


def validate(
    sessions: DataFrame, messages: DataFrame, keys: list[str], known_tools: tuple[str, ...]
) -> DataFrame:
    """Structural problems of normalised sessions; no rows means well-formed.

    ``sessions`` carries ``schema_version, tool, session_id, content_hash``;
    a stored hash is compared with one recomputed from the messages.
    """
    computed = content_hash(messages, keys).withColumnRenamed("content_hash", "_computed")
    joined = sessions.join(computed.select(*keys, "_computed"), keys, "left")
    empty_hash = F.coalesce("_computed", F.lit(None).cast("string"))
    wrong = lambda condition, name: F.when(F.coalesce(condition, F.lit(True)), F.lit(name))
    found = F.array_compact(F.array(
        wrong(F.col("schema_version") != fv.SCHEMA_VERSION, "schema_version"),
        wrong(~F.col("tool").isin(*known_tools), "tool"),
        wrong(F.col("session_id") == "", "session_id"),
        F.when(F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(empty_hash), "content_hash"),
    ))
    header = joined.select(
        *keys, F.explode(found).alias("field"), F.lit(None).cast("long").alias("position")
    )
    return header.unionByName(message_problems(messages, keys))


def union_sessions(pairs: DataFrame, messages: DataFrame, compared: DataFrame) -> DataFrame:
    """Messages of the union of two copies, per ``pair_id``.

    When one copy continues the other the longer one is taken; otherwise the
    first is followed by what the second has after the shared beginning, and
    flagged as a sequence that never happened as one conversation.
    """
    head = compared.select("pair_id", "relation", "common_prefix", "a_length", "longer")
    sided = lambda side, column: (
        pairs.select("pair_id", F.col(column).alias("uid")).join(messages, "uid").withColumn("side", F.lit(side))
    )
    both = sided("a", "a_uid").unionByName(sided("b", "b_uid")).join(head, "pair_id")
    longer = F.coalesce("longer", F.lit("a"))
    extend = F.col("relation") == fv.PREFIX
    kept = both.where(
        F.when(extend, F.col("side") == longer)
        .otherwise((F.col("side") == "a") | (F.col("pos") >= F.col("common_prefix")))
    )
    moved = F.when(
        ~extend & (F.col("side") == "b"), F.col("pos") - F.col("common_prefix") + F.col("a_length")
    ).otherwise(F.col("pos"))
    return (
        kept.withColumn("pos", moved)
        .withColumn("merge_kind", F.when(extend, "prefix-extend").otherwise("concatenated-branches"))
        .drop("relation", "common_prefix", "a_length", "longer", "uid")
    )


def union_hashes(merged: DataFrame, sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digest of each union with the digests of both parents."""
    own = content_hash(merged, ["pair_id", "merge_kind"])
    side = lambda column, out: pairs.select("pair_id", F.col(column).alias("uid")).join(
        sessions.select("uid", F.col("content_hash").alias(out)), "uid"
    ).drop("uid")
    return (
        own.join(side("a_uid", "a_hash"), "pair_id", "left")
        .join(side("b_uid", "b_hash"), "pair_id", "left")
    )


def with_digest(messages: DataFrame) -> DataFrame:
    return messages.withColumn("msg_digest", hashing.message_digest())
