"""Copying, removing and restoring index records between accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.paths import base_name
from sessionlake.functions.jsonvalues import with_fields
from sessionlake.functions.text import bare_id
from sessionlake.session import shared

ACTION_COLUMNS = (
    "kind", "cli_session_id", "desktop_session_id", "title", "project_path", "last_activity_at", "source_account",
    "target_account", "source_path", "dest_path", "new_record_id", "tombstone_path", "was_tombstoned", "reason",
)


def usable_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.where("NOT ambiguous AND history_org IS NOT NULL")


def refused_requests(wanted: DataFrame, account: str, accounts: DataFrame):
    """``wanted`` as ``(open, refused)``: what can be asked of ``account``, and
    what can't, with the reason, because its history is not resolved."""
    known = accounts.select(
        F.col("account_uuid").alias("_account"), F.coalesce(~F.col("ambiguous") & F.col("history_org").isNotNull(), F.lit(False)).alias("_usable"),
        F.col("reason").alias("_reason"))
    asked = wanted.withColumn("_account", F.lit(account)).join(known, "_account", "left").withColumn("_usable", F.coalesce("_usable", F.lit(False)))
    refused = asked.where("NOT _usable").withColumn("_reason", F.coalesce("_reason", F.lit("unknown account")))
    return asked.where("_usable").select(*wanted.columns), refused.select(*wanted.columns, "_reason")


def account_indexes(entries: DataFrame, accounts: DataFrame):
    """Records and tombstones of the usable accounts' history folders.

    ``accounts``: ``account_uuid, position, history_org, history_dir, label,
    ambiguous, reason``.  Of records with one id the last one read counts.
    """
    mine = entries.join(
        usable_accounts(accounts).select("account_uuid", F.col("history_org").alias("organization_uuid"), "position", "history_dir", "label"),
        ["account_uuid", "organization_uuid"],
    )
    columns = F.struct(
        "index_path", "cli_session_id", "title", "project_path", "last_activity_at", "position", "history_dir", "label"
    )
    records = (
        mine.where("kind = 'session'").groupBy("account_uuid", "desktop_session_id")
        .agg(F.max(columns).alias("r")).select("account_uuid", "desktop_session_id", "r.*")
    )
    tombstones = mine.where("kind = 'deleted'").select(
        "account_uuid", bare_id(F.col("desktop_session_id")).alias("bare_id")
    ).distinct()
    return shared(records, "index-records"), tombstones


def by_transcript(records: DataFrame) -> DataFrame:
    """The record of each (account, transcript); the last one read counts."""
    columns = F.struct("index_path", "desktop_session_id", "title", "project_path", "last_activity_at", "position", "history_dir", "label")
    return (
        records.where("cli_session_id <> ''").groupBy("account_uuid", "cli_session_id")
        .agg(F.max(columns).alias("r")).select("account_uuid", "cli_session_id", "r.*")
    )


def classify(candidates: DataFrame, records: DataFrame, tombstones: DataFrame, targets: DataFrame, allow_tombstoned: bool = False) -> DataFrame:
    """What copying each candidate record into its target would do.

    ``candidates``: record columns plus ``source_account, target_account``.
    The transcript identifies a session; the record id is only a file name.
    """
    to = F.col("target_account")
    target = targets.select(F.col("account_uuid").alias("target_account"), F.col("history_dir").alias("_dir"))
    has = lambda f, key, flag: f.select(F.col("account_uuid").alias("target_account"), key, F.lit(True).alias(flag)).distinct()
    bare = bare_id(F.col("desktop_session_id"))
    probed = (
        candidates.withColumn("bare_id", bare).join(target, "target_account")
        .join(has(records.where("cli_session_id <> ''"), "cli_session_id", "_has_transcript"), ["target_account", "cli_session_id"], "left")
        .join(has(records, "desktop_session_id", "_has_record"), ["target_account", "desktop_session_id"], "left")
        .join(has(tombstones, "bare_id", "_deleted"), ["target_account", "bare_id"], "left")
    )
    pointer = F.coalesce(F.col("cli_session_id") != "", F.lit(False))
    present = F.when(pointer, F.col("_has_transcript").isNotNull()).otherwise(F.col("_has_record").isNotNull())
    deleted, taken = F.col("_deleted").isNotNull(), F.col("_has_record").isNotNull()
    copied = ~present & (~deleted | F.lit(allow_tombstoned))
    restores = copied & deleted
    minted = F.when(copied & ~deleted & taken, new_record_id(F.col("cli_session_id"), to))
    path = lambda name: F.concat_ws("/", "_dir", name)
    return probed.select(
        F.when(present, fv.ALREADY_PRESENT).when(copied, fv.COPY).otherwise(fv.TOMBSTONED).alias("kind"),
        "cli_session_id", "desktop_session_id", "title", "project_path", "last_activity_at", "source_account",
        "target_account", F.col("index_path").alias("source_path"),
        F.when(minted.isNotNull(), path(F.concat(minted, F.lit(".json")))).otherwise(path(base_name(F.col("index_path")))).alias("dest_path"),
        minted.alias("new_record_id"),
        F.when(restores, path(F.concat(F.lit("deleted_"), "bare_id"))).alias("tombstone_path"),
        restores.alias("was_tombstoned"),
        F.when(present & pointer, "lists this transcript").when(present, "lists this record")
        .when(restores, "restores a deleted session").when(deleted, "deleted here")
        .when(minted.isNotNull(), "record id in use for another conversation").alias("reason"),
    )


def new_record_id(cli_session_id: Column, account: Column) -> Column:
    """Record id for a copy whose own id is taken; the same on every run."""
    h = F.sha2(F.concat_ws("|", cli_session_id, account), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("local_"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))


def _blocked(frame: DataFrame, reason: Column, target: Column, cli: Column | None = None) -> DataFrame:
    return frame.select(
        F.lit(fv.BLOCKED).alias("kind"), (F.lit(None).cast("string") if cli is None else cli).alias("cli_session_id"),
        target.alias("target_account"), reason.alias("reason"), F.lit(False).alias("was_tombstoned"),
    )


def plan_migrate(requests: DataFrame, target: str, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Copies requested transcripts (``cli_session_id``) into one account.

    The first other account with a record is the source.  Every request into an
    account whose history is not resolved is blocked, with that reason.
    """
    records, tombstones = account_indexes(entries, accounts)
    listed = by_transcript(records)
    wanted, refused = refused_requests(requests.select("cli_session_id").distinct(), target, accounts)
    elsewhere = listed.where(F.col("account_uuid") != target)
    sources = elsewhere.groupBy("cli_session_id").agg(
        F.min(F.struct("position", "account_uuid", "index_path", "desktop_session_id", "title", "project_path", "last_activity_at")).alias("s")
    )
    own = listed.where(F.col("account_uuid") == target).select("cli_session_id", F.struct("index_path", "desktop_session_id", "title", "project_path", "last_activity_at").alias("_own"))
    found = wanted.join(sources, "cli_session_id", "left").join(own, "cli_session_id", "left")
    record = ("index_path", "desktop_session_id", "title", "project_path", "last_activity_at")
    candidates = found.where("s IS NOT NULL").select(
        "cli_session_id", *[F.col(f"s.{c}").alias(c) for c in record],
        F.col("s.account_uuid").alias("source_account"), F.lit(target).alias("target_account"),
    )
    copies = classify(candidates, records, tombstones, usable_accounts(accounts))
    only_here = found.where("s IS NULL AND _own IS NOT NULL").select(
        F.lit(fv.ALREADY_PRESENT).alias("kind"), "cli_session_id", *[F.col(f"_own.{c}").alias(c) for c in record[1:]],
        F.lit(target).alias("source_account"), F.lit(target).alias("target_account"),
        F.col("_own.index_path").alias("source_path"), F.col("_own.index_path").alias("dest_path"),
        F.lit(False).alias("was_tombstoned"), F.lit("lists this transcript").alias("reason"),
    )
    nowhere = _blocked(found.where("s IS NULL AND _own IS NULL"), F.lit("no account lists it"), F.lit(target), F.col("cli_session_id"))
    unresolved = _blocked(refused, F.col("_reason"), F.lit(target), F.col("cli_session_id"))
    return copies.unionByName(only_here, True).unionByName(nowhere, True).unionByName(unresolved, True).select(*ACTION_COLUMNS)


def plan_sync_all(
    entries: DataFrame, accounts: DataFrame, only: DataFrame | None = None, allow_tombstoned: bool = False
) -> DataFrame:
    """Gives every usable account the union of all records, additively.

    One record per session, from the most recently active copy.  ``only``
    restricts it to some ``cli_session_id``.
    """
    records, tombstones = account_indexes(entries, accounts)
    usable = usable_accounts(accounts)
    everyone = usable.agg(F.array_sort(F.collect_set("account_uuid")).alias("a")).scalar()
    pool = records.where(F.size(everyone) >= 2)
    if only is not None:
        pool = pool.join(only.select("cli_session_id").distinct(), "cli_session_id", "left_semi")
    key = F.when(F.col("cli_session_id") != "", F.col("cli_session_id")).otherwise(F.concat(F.lit("record:"), "desktop_session_id"))
    activity = -F.coalesce(F.unix_micros(F.col("last_activity_at").cast("timestamp")), F.lit(0))
    best = pool.groupBy(key.alias("_key")).agg(F.min(F.struct(
        activity.alias("a"), "position", "index_path", "account_uuid", "desktop_session_id", "cli_session_id", "title",
        "project_path", "last_activity_at")).alias("b"))
    candidates = best.select(
        *[F.col(f"b.{c}").alias(c) for c in ("index_path", "desktop_session_id", "cli_session_id", "title", "project_path", "last_activity_at")],
        F.col("b.account_uuid").alias("source_account"),
        F.explode(F.array_except(everyone, F.array("b.account_uuid"))).alias("target_account"),
    )
    actions = classify(candidates, records, tombstones, usable, allow_tombstoned)
    refused = accounts.where("ambiguous OR history_org IS NULL")
    return actions.unionByName(_blocked(refused, F.col("reason"), F.col("account_uuid")), True).select(*ACTION_COLUMNS)


def plan_unlink(requests: DataFrame, account: str, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Removes requested transcripts from one account's history.

    ``also_in`` names the accounts that keep listing the session.  Nothing is
    said about an account whose history is not resolved: all is blocked.
    """
    records, _ = account_indexes(entries, accounts)
    listed = by_transcript(records)
    wanted, refused = refused_requests(requests.select("cli_session_id").distinct(), account, accounts)
    mine = listed.where(F.col("account_uuid") == account).drop("account_uuid", "position", "label")
    others = (
        listed.where(F.col("account_uuid") != account).join(wanted, "cli_session_id", "left_semi")
        .groupBy("cli_session_id")
        # At most one label per account.
        .agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("also_in"), F.count("*").alias("n_also_in"))
    )
    found = wanted.join(mine, "cli_session_id", "left").join(others, "cli_session_id", "left")
    here = F.col("index_path").isNotNull()
    unresolved = _blocked(refused, F.col("_reason"), F.lit(account), F.col("cli_session_id"))
    return found.select(
        F.when(here, fv.REMOVE).otherwise(fv.NOT_PRESENT).alias("kind"), "cli_session_id", "desktop_session_id", "title",
        "project_path", "last_activity_at", F.lit(account).alias("target_account"),
        F.col("index_path").alias("source_path"), F.col("index_path").alias("dest_path"),
        F.when(here, F.concat("history_dir", F.lit("/deleted_"), bare_id(F.col("desktop_session_id")))).alias("tombstone_path"),
        F.lit(False).alias("was_tombstoned"), F.when(here, F.col("also_in")).alias("also_in"),
        F.when(here, F.coalesce("n_also_in", F.lit(0))).alias("n_also_in"),
        F.when(~here, "not listed here").alias("reason"),
    ).unionByName(unresolved, True)


def decide(plan: DataFrame, current_paths: DataFrame) -> DataFrame:
    """Outcome of every action against what exists now.

    A copy never overwrites: a record that appeared since the plan was made is
    left alone.  ``current_paths``: ``index_path``.
    """
    there = current_paths.select(F.col("index_path").alias("dest_path"), F.lit(True).alias("_there")).distinct()
    exists = F.col("_there").isNotNull()
    kind = F.col("kind")
    applied = (
        F.when(kind == fv.REMOVE, "removed")
        .when((kind == fv.COPY) & exists, "skipped")
        .when(kind == fv.COPY, "written")
        .when(kind == fv.BLOCKED, "blocked")
        .otherwise("skipped")
    )
    return plan.join(there, "dest_path", "left").withColumn("applied", applied).withColumn(
        "error", F.when((kind == fv.COPY) & exists, "appeared after the plan was made").when(applied.isin("skipped", "blocked"), F.col("reason"))
    ).drop("_there")


def apply_to_index(outcomes: DataFrame, entries: DataFrame, accounts: DataFrame, now: Column | None = None):
    """Index entries after the plan, and the rows it removed (the backup).

    New index = old − removed − cleared tombstones + copies + new tombstones.
    """
    at = F.current_timestamp() if now is None else now
    written = outcomes.where("applied = 'written'")
    removed = outcomes.where("applied = 'removed'")
    gone = removed.select(F.col("source_path").alias("index_path")).unionByName(
        written.where("was_tombstoned").select(F.col("tombstone_path").alias("index_path"))
    ).distinct()
    kept = entries.join(gone, "index_path", "left_anti")
    org = accounts.select(F.col("account_uuid").alias("target_account"), "history_org")
    new_id = [F.lit(None).cast("string").alias("_new_id")] if "new_record_id" not in outcomes.columns else [F.col("new_record_id").alias("_new_id")]
    moves = written.join(org, "target_account").select(
        F.col("source_path").alias("index_path"), "target_account", "history_org", F.col("dest_path").alias("_to"), *new_id
    )
    copies = (
        entries.join(moves, "index_path")
        .withColumn("account_uuid", F.col("target_account")).withColumn("organization_uuid", F.col("history_org"))
        .withColumn("desktop_session_id", F.coalesce("_new_id", "desktop_session_id")).withColumn("index_path", F.col("_to"))
    )
    if "record_json" in entries.columns:
        # A record carries the id it is filed under.
        copies = copies.withColumn("record_json", F.when(
            F.col("_new_id").isNotNull(), with_fields(F.col("record_json"), {"sessionId": F.col("_new_id")})).otherwise(F.col("record_json")))
    copies = copies.select(*entries.columns)
    have = entries.where("kind = 'deleted'").select(F.col("index_path").alias("tombstone_path"))
    markers = removed.join(have, "tombstone_path", "left_anti").join(org, "target_account").select(
        F.lit("deleted").alias("kind"), F.col("target_account").alias("account_uuid"),
        F.col("history_org").alias("organization_uuid"), bare_id(F.col("desktop_session_id")).alias("desktop_session_id"),
        F.lit(False).alias("is_archived"), at.alias("deleted_at"), F.col("tombstone_path").alias("index_path"),
    )
    markers = markers.select(*[c for c in markers.columns if c in entries.columns])
    after = kept.unionByName(copies).unionByName(markers, True)
    return after.select(*entries.columns), entries.join(gone, "index_path", "left_semi")
