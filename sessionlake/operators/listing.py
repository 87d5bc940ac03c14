"""Session listing: one row per transcript, attributed to accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions import hashing, text as tx
from sessionlake.functions.jsonvalues import field, parse_lines, text_field
from sessionlake.functions.paths import decode_project_dir
from sessionlake.sources.jsonl import head_rows, tail_rows


def header_fields(lines: DataFrame) -> DataFrame:
    """Fields of parsed rows a listing needs, one narrow row per line."""
    row = F.col("row")
    kind = field(row, "$.type")
    model = text_field(row, "$.message.model")
    return lines.where("status = 'ok'").select(
        "file_path", "line_no",
        text_field(row, "$.sessionId").alias("session_id"), text_field(row, "$.cwd").alias("cwd"),
        text_field(row, "$.timestamp").alias("ts"), text_field(row, "$.version").alias("version"),
        text_field(row, "$.gitBranch").alias("git_branch"), model.alias("model"),
        F.when(kind == "custom-title", text_field(row, "$.customTitle")).alias("custom_title"),
        F.when(kind == "ai-title", text_field(row, "$.aiTitle")).alias("ai_title"),
        text_field(row, "$.ownerAccountUuid").alias("owner_account"),
        text_field(row, "$.ownerOrganizationUuid").alias("owner_org"),
    )


def first_of(column: str | Column) -> Column:
    """First non-null value in line order."""
    c = F.col(column) if isinstance(column, str) else column
    return F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))


def last_of(column: str | Column) -> Column:
    """Last non-null value in line order."""
    c = F.col(column) if isinstance(column, str) else column
    return F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))


def session_meta(lines: DataFrame, inventory: DataFrame, sampled: bool = False) -> DataFrame:
    """Listing record of every main transcript in ``inventory``.

    The whole file is used; ``sampled`` restricts it to the first 40 and the
    last 8 rows, for agreement with readers that only look there.
    """
    if sampled:
        head = header_fields(head_rows(lines)).withColumn("_part", F.lit("head"))
        tail = header_fields(tail_rows(lines)).withColumn("_part", F.lit("tail"))
        rows = head.unionByName(tail)
    else:
        rows = header_fields(lines).withColumn("_part", F.lit("both"))
    return _meta_of(rows, inventory)


def sampled_meta(ends: DataFrame, inventory: DataFrame) -> DataFrame:
    """``session_meta`` with ``sampled`` from ``sources.ends.read_ends``: only the
    ends of the files have been read."""
    # Rows of the tail count backwards; those of a head come before any of them.
    rows = header_fields(ends.where("part <> 'error'"))
    late = F.col("line_no") < 0
    rows = rows.withColumn("_part", F.when(late, "tail").otherwise("head")).withColumn(
        "line_no", F.col("line_no") + F.when(late, 2**62).otherwise(0))
    return _meta_of(rows, inventory)


def _meta_of(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    early, late = F.col("_part") != "tail", F.col("_part") != "head"
    in_part = lambda part, c: F.when(part, F.col(c))
    real = F.when(F.col("model") != fv.SYNTHETIC_MODEL, F.col("model"))
    # In a sample the head contributes its first model, the tail its last.
    meta = rows.groupBy("file_path").agg(
        first_of(in_part(early, "session_id")).alias("session_id"),
        first_of(in_part(early, "cwd")).alias("project_path"),
        first_of(in_part(early, "ts")).alias("created_at"),
        last_of(in_part(late, "ts")).alias("updated_at"),
        first_of(in_part(early, "version")).alias("version"),
        first_of(in_part(early, "git_branch")).alias("git_branch"),
        F.coalesce(last_of(F.when(late, real)), first_of(F.when(early, real))).alias("model"),
        F.coalesce(last_of("custom_title"), last_of("ai_title")).alias("title"),
        last_of("owner_account").alias("owner_account"), last_of("owner_org").alias("owner_org"),
    )
    main = inventory.where("kind = 'main'")
    return main.join(meta, "file_path", "left").select(
        "file_path", "root", "project_dir", decode_project_dir(F.col("project_dir")).alias("project_path_decoded"),
        F.coalesce("session_id", "file_session_id").alias("session_id"), "project_path", "model", "title", "version",
        "git_branch", "created_at",
        F.coalesce("updated_at", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("updated_at"),
        "size_bytes", "mtime", "owner_account", "owner_org",
    )


def index_claims(entries: DataFrame) -> DataFrame:
    """Accounts that list a transcript: one row per (transcript id, account).

    ``first_org`` and ``best`` follow the order in which records are read.
    """
    order = F.col("index_path")
    activity = F.coalesce(F.unix_micros(F.col("last_activity_at").cast("timestamp")), F.lit(0))
    best = F.struct((-activity).alias("a"), order.alias("o"), "title", "branch", "desktop_session_id", "is_archived", "project_path")
    return (
        entries.where("kind = 'session' AND cli_session_id <> ''")
        .groupBy("cli_session_id", "account_uuid")
        .agg(F.count("*").alias("records"), F.min(F.struct(order.alias("o"), "organization_uuid")).alias("_first"),
             F.min(best).alias("best"))
    )


def index_summary(claims: DataFrame) -> DataFrame:
    """One row per transcript id: number of accounts, the single one, best entry."""
    return claims.groupBy("cli_session_id").agg(
        F.count("*").alias("n_accounts"), F.sum("records").alias("n_records"),
        F.min("account_uuid").alias("only_account"),
        F.min("_first")["organization_uuid"].alias("only_org"), F.min("best").alias("best"),
    )


def list_sessions(
    meta: DataFrame, inventory: DataFrame, claims: DataFrame, integrity: DataFrame, tool: str, account_id: str | None = None
) -> DataFrame:
    """Listing with sub-agents, warnings and owner.

    Exactly one listing account is the owner; with several the transcript's
    own owner row stands, or the session is shared.
    """
    children = inventory.where("kind <> 'main'").groupBy("root", "parent_session_id").agg(
        F.count("*").alias("sub_agent_count")
    ).withColumnRenamed("parent_session_id", "session_id")
    known = index_summary(claims).withColumnRenamed("cli_session_id", "session_id")
    joined = (
        meta.join(integrity.select("file_path", "integrity"), "file_path", "left")
        .join(children, ["root", "session_id"], "left")
        .join(known, "session_id", "left")
    )
    single = F.col("n_accounts") == 1
    listed = F.col("n_accounts") > 0
    owner = F.col("owner_account")
    state = F.coalesce("integrity", F.lit("unreadable"))
    return joined.select(
        hashing.session_uid(F.lit(tool), F.lit(account_id), F.col("file_path")).alias("uid"),
        "file_path", "root", "project_dir", "project_path_decoded", "session_id",
        F.coalesce("project_path", "best.project_path").alias("project_path"), "model",
        F.coalesce("title", "best.title").alias("title"), "version", "git_branch", "created_at", "updated_at",
        "size_bytes", "mtime", state.alias("integrity"), tx.size_warnings(F.col("size_bytes"), state).alias("warnings"),
        F.coalesce("sub_agent_count", F.lit(0)).alias("sub_agent_count"),
        F.when(single, F.col("only_account")).otherwise(owner).alias("owner_account"),
        F.when(single, F.col("only_org")).otherwise(F.col("owner_org")).alias("owner_org"),
        owner_source(F.col("n_accounts"), owner).alias("owner_source"),
        F.coalesce("n_accounts", F.lit(0)).alias("n_accounts"),
        F.when(listed, F.col("best.branch")).alias("branch"),
        F.when(listed, F.col("best.desktop_session_id")).alias("desktop_session_id"),
        F.when(listed, F.col("best.is_archived")).alias("is_archived"),
    )


def owner_source(n_accounts: Column, transcript_owner: Column) -> Column:
    return (
        F.when(n_accounts == 1, "desktop-index")
        .when((n_accounts > 1) & transcript_owner.isNull(), "shared")
        .when(n_accounts.isNull() & transcript_owner.isNotNull(), "transcript")
    )


def error_entries(inventory: DataFrame, read: DataFrame, tool: str, account_id: str | None = None) -> DataFrame:
    """Files that could not be scanned are rows too."""
    failed = inventory.where("kind = 'main'").join(read.select("file_path").distinct(), "file_path", "left_anti")
    return failed.select(
        hashing.session_uid(F.lit(tool), F.lit(account_id), F.col("file_path")).alias("uid"), "file_path", "root",
        F.element_at(F.split("file_path", "/"), -1).alias("session_id"), F.lit(0).cast("long").alias("size_bytes"),
        F.lit("unreadable").alias("integrity"), F.array(F.lit("scan-failed")).alias("warnings"),
    )


def listed_accounts(
    resolved: DataFrame, described: DataFrame, index: DataFrame, sessions: DataFrame, pairs: DataFrame
) -> DataFrame:
    """The account list: every account that an index folder or a session names.

    ``resolved`` and ``described`` as from ``accounts.resolve_history`` and
    ``describe_accounts``; ``index`` from ``accounts.summarize_index``;
    ``sessions`` from ``list_sessions`` and ``pairs`` from ``session_claims``.
    Accounts are numbered in their order (``place``): the one in use, then the
    ones with most sessions.
    """
    held = owner_accounts(pairs).select(
        "account_uuid", F.col("session_count").alias("transcripts"), F.col("exclusive_count").alias("exclusive"), F.col("bytes"))
    last = pairs.join(sessions.select("uid", "updated_at"), "uid").groupBy("account_uuid").agg(F.max("updated_at").alias("last_at"))
    named = described.select("account_uuid", "label", "label_source", "is_current", "is_signed_in")
    known = resolved.select("account_uuid").union(held.select("account_uuid")).union(index.select("account_uuid")).distinct()
    out = (known.join(resolved.select("account_uuid", "history_org", "history_dir", "confidence", "ambiguous", "reason"), "account_uuid", "left")
           .join(index, "account_uuid", "left").join(held, "account_uuid", "left").join(last, "account_uuid", "left")
           .join(named, "account_uuid", "left")
           .fillna(0, ["organizations", "session_count", "deleted_count", "archived_count", "with_transcript", "transcripts", "exclusive", "bytes"])
           .withColumn("label", F.coalesce("label", tx.short_uuid(F.col("account_uuid"))))
           .withColumn("label_source", F.coalesce("label_source", F.lit("uuid")))
           .withColumn("is_current", F.coalesce("is_current", F.lit(False))).withColumn("is_signed_in", F.coalesce("is_signed_in", F.lit(False)))
           .withColumn("ambiguous", F.coalesce("ambiguous", F.lit(True))).withColumn("reason", F.coalesce("reason", F.lit("no-folder"))))
    order = W.orderBy(F.desc("is_current"), F.desc("session_count"), "account_uuid")
    return out.withColumn("place", F.row_number().over(order))


def scan_totals(sessions: DataFrame, by: str = "root") -> DataFrame:
    """Sessions, bytes and damaged files per root, and over all (null root)."""
    return sessions.rollup(by).agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("integrity").isin(*fv.UNUSABLE)).alias("damaged"),
    )


def session_claims(sessions: DataFrame, claims: DataFrame) -> DataFrame:
    """(session, account) pairs: the listing accounts, or the recorded owner."""
    listed = sessions.select("uid", "session_id", "size_bytes", "n_accounts").join(
        claims.select(F.col("cli_session_id").alias("session_id"), "account_uuid"), "session_id"
    )
    recorded = sessions.where("n_accounts = 0 AND owner_account IS NOT NULL").select(
        "uid", "session_id", "size_bytes", F.lit(1).cast("long").alias("n_accounts"),
        F.col("owner_account").alias("account_uuid"),
    )
    return listed.select(*recorded.columns).unionByName(recorded)


def owner_accounts(pairs: DataFrame, current_account: str | None = None) -> DataFrame:
    """Sessions, exclusive sessions and bytes per account."""
    return pairs.groupBy("account_uuid").agg(
        F.count("*").alias("session_count"), F.count_if(F.col("n_accounts") == 1).alias("exclusive_count"),
        F.sum("size_bytes").alias("bytes"),
    ).withColumn("is_current", F.coalesce(F.col("account_uuid") == F.lit(current_account), F.lit(False)))


def attribution_counts(sessions: DataFrame, by: str = "root") -> DataFrame:
    """Unattributed sessions, and sessions listed by several accounts."""
    return sessions.groupBy(by).agg(
        F.count_if(F.col("owner_account").isNull() & (F.col("n_accounts") == 0)).alias("unattributed"),
        F.count_if(F.col("n_accounts") > 1).alias("shared_across_accounts"),
    )


def file_owners(lines: DataFrame, which: str = "last") -> DataFrame:
    """Owner recorded in each file, by text filter first and parsing second.

    ``lines`` needs ``file_path, line_no, raw``.  The last owner row counts;
    ``which='first'`` takes the first.
    """
    hit = lines.where(F.contains("raw", F.lit("ownerAccountUuid"))).select("file_path", "line_no", "raw")
    opened = parse_lines(hit)
    found = opened.select(
        "file_path", "line_no", text_field(F.col("row"), "$.ownerAccountUuid").alias("account_uuid"),
        text_field(F.col("row"), "$.ownerOrganizationUuid").alias("organization_uuid"),
    ).where("account_uuid IS NOT NULL")
    pick = F.max if which == "last" else F.min
    return found.groupBy("file_path").agg(
        pick(F.struct("line_no", "account_uuid", "organization_uuid")).alias("o")
    ).select("file_path", "o.account_uuid", "o.organization_uuid")


def attribute_accounts(owners: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files and bytes per recorded owner; the null account is unattributed."""
    return inventory.select("file_path", "size_bytes").join(owners, "file_path", "left").groupBy("account_uuid").agg(
        F.count("*").alias("session_count"), F.sum("size_bytes").alias("bytes"),
        F.min_by("organization_uuid", F.when(F.col("organization_uuid").isNotNull(), F.col("file_path"))).alias("organization_uuid"),
    )


def owner_pairs(owned: DataFrame, order: str = "file_path") -> DataFrame:
    """First organisation seen with each account."""
    both = owned.where("account_uuid IS NOT NULL AND organization_uuid IS NOT NULL")
    return both.groupBy("account_uuid").agg(F.min_by("organization_uuid", order).alias("organization_uuid"))


def missing_transcripts(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Transcript ids the index names and the disk lacks: sessions, not rows."""
    named = entries.where("kind = 'session' AND cli_session_id <> ''").select(F.col("cli_session_id").alias("session_id"))
    return named.join(sessions.select("session_id"), "session_id", "left_anti").distinct()


def account_history(
    entries: DataFrame, accounts: DataFrame, sessions: DataFrame, prefer: str = "index"
) -> DataFrame:
    """Entries of each account's resolved folder joined to their transcripts.

    An entry without a transcript stays, marked ``no-transcript``.  ``prefer``
    says whose title is shown.  An account whose folder is not resolved has one
    row that says why (``refused``).  Session ids repeat; the last listed file
    of an id stands for it.
    """
    usable = accounts.where("NOT ambiguous AND history_org IS NOT NULL").select(
        "account_uuid", F.col("history_org").alias("organization_uuid")
    )
    mine = entries.where("kind = 'session'").join(usable, ["account_uuid", "organization_uuid"])
    one = sessions.groupBy("session_id").agg(F.max(F.struct("uid", "title", "size_bytes", "integrity")).alias("s"))
    joined = mine.join(one, mine["cli_session_id"] == one["session_id"], "left")
    real = F.col("s").isNotNull()
    refused = accounts.where("ambiguous OR history_org IS NULL").select(
        "account_uuid", F.lit(False).alias("has_transcript"), F.coalesce("reason", F.lit("not resolved")).alias("refused"))
    titles = ["title", "s.title"] if prefer == "index" else ["s.title", "title"]
    return joined.select(
        F.coalesce("s.uid", F.concat(F.lit("index:"), "desktop_session_id")).alias("uid"), "account_uuid",
        F.coalesce("cli_session_id", "desktop_session_id").alias("session_id"), F.coalesce(*titles).alias("title"),
        F.col("s.size_bytes").alias("size_bytes"),
        F.when(real, F.col("s.integrity")).otherwise("no-transcript").alias("integrity"),
        real.alias("has_transcript"), "index_path", F.lit(None).cast("string").alias("refused"),
    ).unionByName(refused, True)
