"""Import of a snapshot: one decision per recorded session, applied on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.paths import contained_in, encode_project_dir, safe_relative_path, suffixed_path
from sessionlake.operators import compare
from sessionlake.plans.sync import settle_writes
from sessionlake.session import shared


def with_destination(records: DataFrame, roots: DataFrame, target_tool: str | None = None) -> DataFrame:
    """Adds ``dest_tool, root, dest_path, note``.

    The recorded relative path is used when it is safe and stays inside the
    root; otherwise the place follows from the working directory.  ``roots``:
    ``dest_tool, root`` (one root per tool).
    """
    tool = F.lit(target_tool) if target_tool else F.col("tool")
    placed = records.withColumn("dest_tool", tool).join(roots, "dest_tool", "left")
    root = F.col("root")
    relative = safe_relative_path(F.col("original_relative"))
    recorded = F.when(F.col("dest_tool") == F.col("tool"), F.concat_ws("/", root, F.when(root.isNotNull(), relative)))
    recorded = F.when(relative.isNotNull() & contained_in(root, recorded), recorded)
    derived = F.concat(
        root, F.lit("/projects/"), encode_project_dir(F.col("project_path"), "imported"),
        F.lit("/"), F.col("session_id"), F.lit(".jsonl"),
    )
    derived = F.when(contained_in(root, derived), derived)
    strange = (F.col("dest_tool") == F.col("tool")) & (F.col("original_relative") != "") & recorded.isNull()
    return placed.withColumn("dest_path", F.coalesce(recorded, derived)).withColumn(
        "note", F.when(strange & root.isNotNull(), "recorded location ignored: outside the root")
    )


def _first(sessions: DataFrame, keys: list[str], name: str) -> DataFrame:
    """First existing session per key, latest update first; combines map-side."""
    newest = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1))
    order = F.struct(newest.alias("t"), F.col("uid").alias("u"))
    return sessions.groupBy(*keys).agg(
        F.min(F.struct(order.alias("o"), "uid", "file_path")).alias(name)
    )


def plan_import(
    records: DataFrame, roots: DataFrame, sessions: DataFrame, messages: DataFrame, files: DataFrame,
    target_tool: str | None = None,
) -> DataFrame:
    """Decides every record of a snapshot; first matching rule wins.

    ``records``: ``manifest_index, snapshot_uid, session_id, tool,
    project_path, title, original_relative, content_hash, message_count,
    raw_digest, raw_size, integrity``; ``sessions`` (already there): ``uid,
    dest_tool, session_id, file_path, size_bytes, content_hash, message_count,
    updated_at``; ``messages``: both sides, by ``uid``; ``files``: ``file_path,
    raw_digest`` of everything at the destination.

    A record meets at most four existing sessions: the one at its path, the
    first of its id, the first of its size and the first of its content.
    """
    records, sessions = shared(records, "import-records"), shared(sessions, "import-sessions")
    placed = with_destination(records, roots, target_tool)
    parsed = sessions.where("content_hash is not null")
    at_path = parsed.select(
        F.col("file_path").alias("dest_path"), F.struct("uid", "file_path", "content_hash").alias("at_path")
    )
    joined = (
        placed
        .join(files.select(F.col("file_path").alias("dest_path"), F.col("raw_digest").alias("_there_digest"),
                           F.lit(True).alias("_there")), "dest_path", "left")
        .join(at_path, "dest_path", "left")
        .join(_first(parsed, ["dest_tool", "session_id"], "by_id"), ["dest_tool", "session_id"], "left")
        .join(_first(parsed, ["dest_tool", "content_hash"], "by_hash"), ["dest_tool", "content_hash"], "left")
        .join(_first(parsed.withColumnRenamed("size_bytes", "raw_size"), ["dest_tool", "raw_size"], "by_size"),
              ["dest_tool", "raw_size"], "left")
    )
    same_path_hash = F.col("at_path.content_hash") == F.col("content_hash")
    matched = F.when(same_path_hash, F.col("at_path.file_path")).otherwise(F.col("by_hash.file_path"))
    best_uid = F.coalesce("at_path.uid", "by_id.uid", "by_size.uid")
    best_path = F.coalesce("at_path.file_path", "by_id.file_path", "by_size.file_path")
    there = F.coalesce("_there", F.lit(False))
    rule = (
        F.when(F.col("integrity").isin(*fv.UNUSABLE), "source-damaged")
        .when(F.col("root").isNull(), "no-root")
        .when(F.col("dest_path").isNull(), "no-destination")
        .when(there & (F.col("_there_digest") == F.col("raw_digest")), "same-bytes")
        .when(matched.isNotNull(), "same-content")
        .when(best_uid.isNotNull(), "differs")
        .when(there, "unreadable-destination")
        .otherwise("absent")
    )
    ruled = shared(joined.select(
        "manifest_index", "snapshot_uid", "session_id", "tool", "dest_tool", "title", "project_path",
        "content_hash", "message_count", "raw_digest", "integrity", "root", "dest_path", "note",
        rule.alias("rule"), best_uid.alias("existing_uid"),
        F.when(rule == "same-bytes", F.col("dest_path")).when(rule == "same-content", matched)
        .when(rule == "differs", best_path).when(rule == "unreadable-destination", F.col("dest_path"))
        .alias("existing_path"),
    ), "import-rules")
    pairs = ruled.where("rule = 'differs'").select(
        F.col("manifest_index").alias("pair_id"), F.col("existing_uid").alias("a_uid"),
        F.col("snapshot_uid").alias("b_uid"),
    )
    incoming = records.select(
        F.col("snapshot_uid").alias("uid"), "content_hash", "message_count",
        (F.col("updated_at") if "updated_at" in records.columns else F.lit(None)).cast("timestamp").alias("updated_at"),
    )
    facts = sessions.select("uid", "content_hash", "message_count", "updated_at").unionByName(incoming)
    compared = compare.with_recommendation(compare.compare(pairs, messages, facts)).select(
        F.col("pair_id").alias("manifest_index"), "relation", "common_prefix", "diverge_index", "a_only", "b_only",
        "newer", F.col("recommendation").alias("_advice"),
    )
    out = ruled.join(compared, "manifest_index", "left")
    rule = F.col("rule")
    kind = (
        F.when(rule.isin("source-damaged", "no-root", "no-destination"), fv.BLOCKED)
        .when(rule.isin("same-bytes", "same-content"), fv.SKIP_IDENTICAL)
        .when((rule == "differs") & (F.col("relation") == fv.IDENTICAL), fv.SKIP_IDENTICAL)
        .when(rule.isin("differs", "unreadable-destination"), fv.CONFLICT)
        .otherwise(fv.WRITE)
    )
    advice = F.when(rule == "unreadable-destination", fv.KEEP_BOTH).otherwise(F.col("_advice"))
    return out.withColumn("kind", kind).withColumn("recommendation", advice).drop("_advice")


def decide(
    plan: DataFrame, records: DataFrame, resolutions: DataFrame, existing_paths: DataFrame,
    stamp: Column | None = None, restored: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every planned import.

    Records are found by position and must still carry the planned session id.
    ``resolutions``: ``manifest_index, resolution``.  ``restored``:
    ``manifest_index, raw_digest, integrity`` recomputed from the snapshot's
    raw lines; a mismatch or damage refuses the write.
    """
    current = records.select("manifest_index", F.col("session_id").alias("_now"))
    chosen = plan.join(current, "manifest_index", "left").join(resolutions, "manifest_index", "left")
    if restored is not None:
        chosen = chosen.join(
            restored.select("manifest_index", F.col("raw_digest").alias("_digest"), F.col("integrity").alias("_state")),
            "manifest_index", "left",
        )
        bad = ~F.col("_digest").eqNullSafe(F.col("raw_digest")) | F.coalesce(F.col("_state").isin(*fv.UNUSABLE), F.lit(True))
    else:
        bad = F.lit(False)
    choice, newer = F.col("resolution"), F.col("newer") == "b"
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if stamp is None else stamp
    beside = suffixed_path(F.col("dest_path"), F.concat(F.lit("imported-"), day))
    intent = (
        F.when(F.col("_now").isNull() | (F.col("_now") != F.col("session_id")), "failed")
        .when(F.col("kind") == fv.BLOCKED, "blocked")
        .when(F.col("kind") == fv.SKIP_IDENTICAL, "skipped-identical")
        .when(F.col("kind") == fv.WRITE, "written")
        .when(choice.isNull() | (choice == fv.SKIP), "skipped-unresolved")
        .when(choice == fv.KEEP_EXISTING, "kept-existing")
        .when(choice == fv.KEEP_INCOMING, "overwritten")
        .when((choice == fv.KEEP_NEWER) & newer, "overwritten-newer")
        .when(choice == fv.KEEP_NEWER, "kept-existing-newer")
        .when(choice == fv.KEEP_BOTH, "written-alongside")
        .otherwise("skipped-unknown-resolution")
    )
    writing = F.col("_intent").isin("written", "overwritten", "overwritten-newer", "written-alongside")
    staged = chosen.withColumn("_intent", intent)
    staged = staged.withColumn("_intent", F.when(writing & bad, "failed").otherwise(F.col("_intent")))
    path = F.when(F.col("_intent") == "written-alongside", beside).when(writing, F.col("dest_path"))
    staged = staged.withColumn("_path", path)
    dropped = [c for c in ("_now", "_digest", "_state") if c in staged.columns]
    return settle_writes(staged.drop(*dropped), existing_paths, ["manifest_index"])


def apply_to_files(outcomes: DataFrame, raw_lines: DataFrame, files: DataFrame):
    """Destination file table after the import, and the rows it replaced.

    ``raw_lines``: snapshot lines keyed by ``snapshot_uid``; restored verbatim.
    """
    replaced = outcomes.where("overwrites").select(F.col("write_path").alias("file_path")).distinct()
    writes = outcomes.where("write_path is not null").select("snapshot_uid", F.col("write_path").alias("file_path"))
    incoming = raw_lines.join(writes, "snapshot_uid").select(*files.columns)
    kept = files.join(replaced, "file_path", "left_anti")
    return kept.unionByName(incoming), files.join(replaced, "file_path", "left_semi")


def remap_accounts(normalized: DataFrame, remap: DataFrame) -> DataFrame:
    """Migration import: account ids of normalised sessions become the
    destination's; raw rows are never edited.  ``remap``: ``tool, dest_account_id``."""
    return (
        normalized.join(remap, "tool", "left")
        .withColumn("account_id", F.coalesce("dest_account_id", "account_id"))
        .drop("dest_account_id")
    )
