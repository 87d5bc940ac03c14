"""Union of the sessions of several accounts, by content; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.paths import base_name, suffixed_path
from sessionlake.operators import compare
from sessionlake.session import shared

RESULT_COLUMNS = (
    "kind", "content_hash", "session_id", "title", "message_count", "size_bytes", "source_uid", "source_root",
    "source_path", "dest_root", "dest_path", "existing_uid", "relation", "common_prefix", "diverge_index",
    "a_only", "b_only", "newer", "recommendation", "reason",
)


def select_accounts(available: DataFrame, requested: list[str] | None = None):
    """Accounts taking part, requested ones that do not exist, and excluded ones.

    ``available``: ``root, label``.  Roots compare without regard to case.
    """
    if not requested:
        none = available.where(F.lit(False))
        return available, none.select("root"), none
    wanted = available.sparkSession.createDataFrame([(r,) for r in requested], "root string")
    folded = lambda f: f.withColumn("_key", F.lower(F.rtrim(F.col("root"), F.lit("/"))))
    have, want = folded(available), folded(wanted)
    chosen = have.join(want.select("_key").distinct(), "_key", "left_semi").drop("_key")
    unmatched = want.join(have.select("_key"), "_key", "left_anti").select("root")
    excluded = have.join(want.select("_key"), "_key", "left_anti").drop("_key")
    return chosen, unmatched, excluded


def _load_order() -> Column:
    """Accounts in their order, then latest update first, then uid."""
    newest = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1))
    return F.struct(F.col("_account").alias("a"), newest.alias("t"), F.col("uid").alias("u"))


def plan_sync(
    accounts: DataFrame, sessions: DataFrame, messages: DataFrame, include_damaged: bool = False,
    unmatched: DataFrame | None = None,
) -> DataFrame:
    """One action per (content, account that lacks it).

    ``accounts``: ``root, position``; ``sessions``: ``uid, root, session_id,
    content_hash, message_count, integrity, updated_at, rel_path, title,
    size_bytes``; ``messages``: ``uid, pos, msg_digest``.  With fewer than two
    accounts, or any request in ``unmatched``, the plan is empty.
    """
    # The accounts are a short list of folders; as an array they let every
    # content name the ones it lacks without joining contents and accounts.
    sessions = shared(sessions, "sync-sessions")
    roots = accounts.agg(F.array_sort(F.collect_set("root")).alias("r")).scalar()
    mine = sessions.join(accounts.select("root", F.col("position").alias("_account")), "root")
    if unmatched is not None:
        mine = mine.where(unmatched.agg(F.count("*").alias("n")).scalar() == 0)
    mine = mine.where(F.size(roots) >= 2)
    unusable = F.col("integrity").isin(*fv.UNUSABLE)
    loaded = mine if include_damaged else mine.where(~unusable)
    loaded = loaded.where("content_hash is not null")

    # One row per (content, account), then one per content: both combine
    # map-side, so a content held a billion times is a few rows in the shuffle.
    facts = F.struct(
        _load_order().alias("o"), "uid", "session_id", "root", "rel_path", "title", "message_count", "size_bytes"
    )
    held = loaded.groupBy("content_hash", "root").agg(F.min(facts).alias("s"))
    contents = held.groupBy("content_hash").agg(
        F.min("s").alias("s"), F.collect_list("root").alias("_holders")
    )
    # The session an account already keeps under an id.  Any of them differs
    # from a content the account lacks, so the first one decides.
    kept = loaded.where("session_id is not null").groupBy("root", "session_id").agg(
        F.min(F.struct(_load_order().alias("o"), "uid", "rel_path")).alias("e"))
    kept = kept.groupBy("session_id").agg(
        F.map_from_entries(F.collect_list(F.struct("root", F.struct("e.uid", "e.rel_path").alias("e")))).alias("_kept"))
    # A content stays one row with the accounts it lacks, and what they keep
    # under its id, until the plan is spelled out: only uids travel per account.
    target = lambda d: F.struct(d.alias("root"), F.try_element_at("_kept", d).alias("e"))
    base = shared(
        contents.select("content_hash", "s.*", F.array_except(roots, "_holders").alias("_lacking"))
        .join(kept, "session_id", "left")
        .select(
            "content_hash", "session_id", "title", "message_count", "size_bytes", F.col("uid").alias("source_uid"),
            F.col("root").alias("source_root"), F.col("rel_path").alias("_rel"), F.transform("_lacking", target).alias("_targets"),
        ), "sync-actions")
    everywhere = base.where(F.size("_targets") == 0).select(
        F.lit(fv.ALREADY_EVERYWHERE).alias("kind"), "content_hash", "session_id", "title",
        F.lit("every account has it").alias("reason"),
    )

    # Distinct pairs: one content in conflict with one session in many places
    # is compared once.
    pairs = (
        base.select("source_uid", F.explode("_targets").alias("t")).where("t.e.uid is not null")
        .select(F.col("t.e.uid").alias("a_uid"), F.col("source_uid").alias("b_uid")).distinct()
        .withColumn("pair_id", F.struct("a_uid", "b_uid"))
    )
    result = F.struct(
        F.col("a_uid").alias("existing_uid"), "relation", "common_prefix", "diverge_index", "a_only", "b_only", "newer", "longer")
    compared = compare.compare(pairs, messages, sessions).groupBy(F.col("b_uid").alias("source_uid")).agg(
        F.collect_list(result).alias("_compared"))
    path = lambda root, rel: F.concat_ws("/", root, rel)
    there = F.col("t.e").isNotNull()
    spelled = (
        base.where(F.size("_targets") > 0).join(compared, "source_uid", "left").withColumn("t", F.explode("_targets"))
        .withColumn("c", F.explode_outer(F.filter("_compared", lambda x: x["existing_uid"] == F.col("t.e.uid"))))
        .select(
            F.when(there, fv.CONFLICT).otherwise(fv.COPY).alias("kind"), "content_hash", "session_id", "title", "message_count",
            "size_bytes", "source_uid", "source_root", path(F.col("source_root"), F.col("_rel")).alias("source_path"),
            F.col("t.root").alias("dest_root"), path(F.col("t.root"), F.when(there, F.col("t.e.rel_path")).otherwise(F.col("_rel"))).alias("dest_path"),
            F.col("t.e.uid").alias("existing_uid"), F.col("c.relation").alias("relation"), "c.common_prefix", "c.diverge_index",
            "c.a_only", "c.b_only", "c.newer", "c.longer",
        )
    )
    told = F.col("relation").isNotNull()
    advised = compare.with_recommendation(spelled)
    planned = advised.withColumn("recommendation", F.when(told, F.col("recommendation"))).withColumn(
        "reason", F.when(told, F.col("recommendation_reason"))).drop("recommendation_reason", "longer")

    blocked = mine.where(unusable & F.lit(not include_damaged)).select(
        F.lit(fv.BLOCKED).alias("kind"), "session_id", F.col("uid").alias("source_uid"),
        F.col("root").alias("source_root"), path(F.col("root"), F.col("rel_path")).alias("source_path"),
        F.concat(F.lit("source is "), "integrity").alias("reason"),
    )
    out = planned.unionByName(everywhere, True).unionByName(blocked, True)
    return out.select(*RESULT_COLUMNS)


def decide(plan: DataFrame, resolutions: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Outcome of every action, given explicit choices and what exists now.

    ``resolutions``: ``session_id, dest_root, resolution``; a conflict without
    one is left untouched.  ``existing_paths``: ``file_path``.  Adds
    ``applied``, ``write_path`` (null when nothing is written), ``overwrites``.
    """
    chosen = plan.join(resolutions, ["session_id", "dest_root"], "left")
    choice, conflict = F.col("resolution"), F.col("kind") == fv.CONFLICT
    newer = F.col("newer") == "b"
    beside = suffixed_path(F.col("dest_path"), F.concat(F.lit("from-"), base_name(F.col("source_root"))))
    intent = (
        F.when(F.col("kind") == fv.ALREADY_EVERYWHERE, "no-op")
        .when(F.col("kind") == fv.BLOCKED, "blocked")
        .when(F.col("kind") == fv.COPY, "copied")
        .when(choice.isNull() | (choice == fv.SKIP), "skipped-unresolved")
        .when(choice == fv.KEEP_EXISTING, "kept-existing")
        .when(choice == fv.KEEP_INCOMING, "overwritten")
        .when((choice == fv.KEEP_NEWER) & newer, "overwritten-newer")
        .when(choice == fv.KEEP_NEWER, "kept-existing-newer")
        .when(choice == fv.KEEP_BOTH, "written-alongside")
        .otherwise("skipped-unknown-resolution")
    )
    written = (
        F.when(F.col("_intent").isin("copied", "overwritten", "overwritten-newer"), F.col("dest_path"))
        .when(F.col("_intent") == "written-alongside", beside)
    )
    staged = chosen.withColumn("_intent", intent).withColumn("_path", written)
    return settle_writes(staged, existing_paths, ["content_hash", "dest_root"])


def settle_writes(staged: DataFrame, existing_paths: DataFrame, order: list[str]) -> DataFrame:
    """Turns intended writes into outcomes.

    Only an overwrite may meet an existing path; of several writes to one path
    the first is made.  ``_intent`` and ``_path`` become ``applied`` and
    ``write_path``; a refused write is ``failed``.
    """
    may_replace = F.col("_intent").isin("overwritten", "overwritten-newer")
    there = existing_paths.select(F.col("file_path").alias("_path"), F.lit(True).alias("_there")).distinct()
    # A refused write does not take the path from one that is allowed, and
    # actions that write nothing do not share a group.
    joined = staged.join(there, "_path", "left").withColumn(
        "_refused", F.col("_there").isNotNull() & ~may_replace
    ).withColumn("_row", F.monotonically_increasing_id())
    first = W.partitionBy(F.coalesce("_path", F.col("_row").cast("string")), "_refused").orderBy(*order)
    writing = F.col("_path").isNotNull()
    lost = writing & (F.col("_refused") | (F.col("_turn") > 1))
    return (
        joined.withColumn("_turn", F.row_number().over(first))
        .withColumn("applied", F.when(lost, "failed").otherwise(F.col("_intent")))
        .withColumn("write_path", F.when(~lost, F.col("_path")))
        .withColumn("overwrites", writing & F.col("_there").isNotNull() & ~lost)
        .withColumn("error", F.when(writing & F.col("_refused"), "destination already exists")
                    .when(lost, "another action of this plan writes there"))
        .drop("_intent", "_path", "_there", "_refused", "_turn", "_row")
    )


def apply_to_files(outcomes: DataFrame, files: DataFrame, companions: DataFrame | None = None):
    """The file table after the plan, and the rows it replaced.

    ``files`` has ``file_path`` and any content columns (one row per line).
    ``companions`` (``uid, root, rel_path, file_path``) are files that follow a
    copied session unless their destination exists.
    """
    writes = outcomes.where("write_path is not null").select(
        F.col("source_path").alias("file_path"), F.col("write_path").alias("_to")
    )
    if companions is not None:
        copied = outcomes.where("applied = 'copied'").select(F.col("source_uid").alias("uid"), "dest_root")
        extra = copied.join(companions, "uid").select(
            "file_path", F.concat_ws("/", "dest_root", "rel_path").alias("_to")
        ).dropDuplicates(["_to"])
        present = files.select(F.col("file_path").alias("_to")).distinct()
        writes = writes.unionByName(extra.join(present, "_to", "left_anti").select("file_path", "_to"))
    replaced = outcomes.where("overwrites").select(F.col("write_path").alias("file_path")).distinct()
    incoming = files.join(writes, "file_path").withColumn("file_path", F.col("_to")).drop("_to")
    kept = files.join(replaced, "file_path", "left_anti")
    backups = files.join(replaced, "file_path", "left_semi")
    return kept.unionByName(incoming.select(*files.columns)), backups
