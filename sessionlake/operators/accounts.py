"""Accounts: which folder holds an account's history, and what to call it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.text import short_uuid


def summarize_index(entries: DataFrame) -> DataFrame:
    """Counts per account over all its entries; organisations are counted."""
    session = F.col("kind") == "session"
    per_org = entries.groupBy("account_uuid", "organization_uuid").agg(
        F.count_if(session).alias("s"), F.count_if(~session).alias("d"),
        F.count_if(session & F.col("is_archived")).alias("a"),
        F.count_if(session & (F.col("cli_session_id") != "")).alias("c"),
    )
    total = lambda c, out: F.sum(c).alias(out)
    return per_org.groupBy("account_uuid").agg(
        F.count("organization_uuid").alias("organizations"), total("s", "session_count"), total("d", "deleted_count"),
        total("a", "archived_count"), total("c", "with_transcript"),
    )


def resolve_history(
    folders: DataFrame, signed_in: DataFrame | None = None, declared: DataFrame | None = None,
    transcript_pairs: DataFrame | None = None, accounts: DataFrame | None = None,
) -> DataFrame:
    """Organisation folder that holds each account's history, or a refusal.

    ``folders``: ``account_uuid, organization_uuid, dir, session_count,
    deleted_count, created_ms, account_created_ms``.  The hint frames carry
    ``account_uuid, organization_uuid``, one row per account.  ``accounts``
    lists accounts that may have no folder at all.  Signals are tried from the
    strongest; several candidates at one level refuse instead of guessing.
    """
    marked = folders
    for name, hint in (("signed", signed_in), ("declared", declared), ("paired", transcript_pairs)):
        if hint is None:
            marked = marked.withColumn(f"_{name}", F.lit(False))
            continue
        flag = hint.select("account_uuid", "organization_uuid", F.lit(True).alias(f"_{name}")).distinct()
        marked = marked.join(flag, ["account_uuid", "organization_uuid"], "left").fillna(False, [f"_{name}"])
    populated = (F.col("session_count") > 0) | (F.col("deleted_count") > 0)
    together = F.coalesce(
        F.abs(F.col("created_ms") - F.col("account_created_ms")) <= fv.BIRTH_TOLERANCE_MS, F.lit(False)
    )
    org = F.col("organization_uuid")
    signals = marked.groupBy("account_uuid").agg(
        F.count("*").alias("n_folders"),
        F.min(F.when(F.col("_signed"), org)).alias("signed_org"),
        F.min(F.when(F.col("_declared"), org)).alias("declared_org"),
        F.min(F.when(F.col("_paired"), org)).alias("paired_org"),
        F.count_if(populated).alias("n_populated"), F.min(F.when(populated, org)).alias("populated_org"),
        F.min(org).alias("any_org"),
        F.count_if(together).alias("n_born"), F.min(F.when(together, org)).alias("born_org"),
        F.sum("session_count").alias("session_count"), F.sum("deleted_count").alias("deleted_count"),
    )
    if accounts is not None:
        signals = accounts.select("account_uuid").distinct().join(signals, "account_uuid", "left").fillna(
            0, ["n_folders", "n_populated", "n_born", "session_count", "deleted_count"])
    empty = F.col("n_populated") == 0
    chain = (
        F.when(F.col("n_folders") == 0, F.struct(F.lit(None).cast("string").alias("org"), F.lit("no-folder").alias("why")))
        .when(F.col("signed_org").isNotNull(), F.struct(F.col("signed_org").alias("org"), F.lit("signed-in").alias("why")))
        .when(F.col("declared_org").isNotNull(), F.struct(F.col("declared_org").alias("org"), F.lit("account-config").alias("why")))
        .when(F.col("paired_org").isNotNull(), F.struct(F.col("paired_org").alias("org"), F.lit("transcript").alias("why")))
        .when(F.col("n_populated") == 1, F.struct(F.col("populated_org").alias("org"), F.lit("populated").alias("why")))
        .when(F.col("n_populated") > 1, F.struct(F.lit(None).cast("string").alias("org"), F.lit("several-populated").alias("why")))
        .when(empty & (F.col("n_folders") == 1), F.struct(F.col("any_org").alias("org"), F.lit("only-folder").alias("why")))
        .when(F.col("n_born") == 1, F.struct(F.col("born_org").alias("org"), F.lit("born-together").alias("why")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("org"), F.lit("several-empty").alias("why")))
    )
    resolved = signals.withColumn("_r", chain)
    refused = F.col("_r.org").isNull()
    out = resolved.select(
        "account_uuid", F.col("_r.org").alias("history_org"),
        F.when(refused, "none").otherwise(F.col("_r.why")).alias("confidence"),
        F.col("_r.why").alias("reason"), refused.alias("ambiguous"), "n_folders", "session_count", "deleted_count",
    )
    place = folders.select("account_uuid", F.col("organization_uuid").alias("history_org"), F.col("dir").alias("history_dir"))
    return out.join(place, ["account_uuid", "history_org"], "left")


def describe_accounts(
    accounts: DataFrame, custom: DataFrame, known: DataFrame, signed_in: DataFrame, current: DataFrame | None = None
) -> DataFrame:
    """Display name of every account and where it comes from.

    ``custom``: ``account_uuid, label``; ``known`` and ``signed_in``:
    ``account_uuid, email, display_name, organization_name``; ``current``: the
    account in use, when that is known (otherwise the signed-in one).
    """
    fields = ("email", "display_name", "organization_name")
    live = signed_in.select("account_uuid", F.lit(True).alias("_live"), *[F.col(c).alias(f"_live_{c}") for c in fields])
    learned = known.select("account_uuid", *[F.col(c).alias(f"_known_{c}") for c in fields])
    chosen = custom.select("account_uuid", F.col("label").alias("_custom"))
    joined = accounts.join(chosen, "account_uuid", "left").join(learned, "account_uuid", "left").join(live, "account_uuid", "left")
    is_live = F.coalesce("_live", F.lit(False))
    value = lambda c: F.when(is_live, F.col(f"_live_{c}")).otherwise(F.col(f"_known_{c}"))
    filled = lambda c: F.when(c != "", c)
    name = F.coalesce(filled(value("email")), filled(value("display_name")))
    custom_name = filled(F.col("_custom"))
    if current is None:
        joined = joined.withColumn("_current", is_live)
    else:
        joined = joined.join(
            current.select("account_uuid", F.lit(True).alias("_current")).distinct(), "account_uuid", "left")
    return joined.select(
        *accounts.columns,
        F.coalesce(custom_name, name, short_uuid(F.col("account_uuid"))).alias("label"),
        F.when(custom_name.isNotNull(), "custom").when(name.isNotNull() & is_live, "signed-in")
        .when(name.isNotNull(), "learned").otherwise("uuid").alias("label_source"),
        F.coalesce("_current", F.lit(False)).alias("is_current"), is_live.alias("is_signed_in"),
        *[value(c).alias(c) for c in fields],
    )


def learn_identities(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored identities after meeting new ones; a name is never lost."""
    fields = [c for c in known.columns if c != "account_uuid"]
    fresh = seen.select("account_uuid", F.lit(True).alias("_seen"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = known.withColumn("_had", F.lit(True)).join(fresh, "account_uuid", "full_outer")
    named = lambda p: (F.coalesce(p("email"), F.lit("")) != "") | (F.coalesce(p("display_name"), F.lit("")) != "")
    keep = F.col("_seen").isNull() | (
        F.col("_had").isNotNull() & named(F.col) & ~named(lambda c: F.col(f"_new_{c}"))
    )
    return joined.select(
        "account_uuid", *[F.when(keep, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in fields]
    )
