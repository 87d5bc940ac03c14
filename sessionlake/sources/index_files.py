"""Per-account session indexes and identity documents (small JSON files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.jsonvalues import canonical, field, parse_lines, text_field
from sessionlake.functions.paths import clean_path
from sessionlake.functions.text import is_uuid, millis_to_timestamp
from sessionlake.session import configure
from sessionlake.sources.inventory import list_entries, list_files

_PLACE = r"^(.*)/([^/]+)/([^/]+)/([^/]+)$"


def read_documents(spark: SparkSession, roots: str | list[str], glob: str = "*") -> DataFrame:
    """``file_path, size_bytes, raw`` of small files; ``raw`` is null for empty ones."""
    configure(spark)
    contents = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").text(roots)
        .select(clean_path(F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("raw"))
    )
    return list_files(spark, roots, glob).select("file_path", "size_bytes").join(contents, "file_path", "left")


def _number(row: Column, path: str) -> Column:
    """Numeric field; text that looks like a number is not one."""
    value = field(row, path, "variant")
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), field(row, path, "double"))


def parse_records(documents: DataFrame, strict_folders: bool = True) -> DataFrame:
    """Index records and tombstones from ``file_path, raw``.

    ``kind`` is session, deleted or unreadable.  With ``strict_folders`` only
    folders named by UUIDs count.
    """
    path = F.col("file_path")
    placed = documents.select(
        "file_path", "raw",
        F.regexp_extract(path, _PLACE, 2).alias("account_uuid"),
        F.regexp_extract(path, _PLACE, 3).alias("organization_uuid"),
        F.regexp_extract(path, _PLACE, 4).alias("name"),
    )
    tombstone = F.startswith("name", F.lit("deleted_"))
    record = F.startswith("name", F.lit("local_")) & F.endswith("name", F.lit(".json"))
    kept = placed.where(tombstone | record)
    if strict_folders:
        kept = kept.where(is_uuid(F.col("account_uuid"), True) & is_uuid(F.col("organization_uuid"), True))
    opened = parse_lines(kept)
    row = F.col("row")
    archived = field(row, "$.isArchived")
    session = F.when(~tombstone, row)
    stamp = lambda p: millis_to_timestamp(_number(session, p))
    return opened.select(
        F.when(tombstone, "deleted").when(row.isNotNull(), "session").otherwise("unreadable").alias("kind"),
        "account_uuid", "organization_uuid",
        F.when(tombstone, F.substring("name", 9, 1 << 30))
        .otherwise(F.coalesce(field(row, "$.sessionId"), F.regexp_replace("name", r"\.json$", "")))
        .alias("desktop_session_id"),
        field(session, "$.cliSessionId").alias("cli_session_id"),
        field(session, "$.title").alias("title"),
        F.coalesce(field(session, "$.originCwd"), field(session, "$.cwd")).alias("project_path"),
        field(session, "$.cwd").alias("worktree_cwd"), field(session, "$.originCwd").alias("origin_cwd"),
        field(session, "$.branch").alias("branch"), field(session, "$.sourceBranch").alias("source_branch"),
        field(session, "$.model").alias("model"), field(session, "$.effort").alias("effort"),
        (~tombstone & ~F.coalesce(archived.isin("false", "", "0", "null"), F.lit(True))).alias("is_archived"),
        _number(session, "$.completedTurns").cast("long").alias("completed_turns"),
        stamp("$.createdAt").alias("created_at"), stamp("$.lastActivityAt").alias("last_activity_at"),
        stamp("$.lastFocusedAt").alias("last_focused_at"),
        field(session, "$.spawnedFrom.sessionId").alias("spawned_from"),
        F.when(tombstone, millis_to_timestamp(F.trim("raw").try_cast("double"))).alias("deleted_at"),
        F.col("file_path").alias("index_path"),
        # The whole record: copies and repairs keep fields that are not modelled.
        canonical(session).alias("record_json"),
    )


def read_index(spark: SparkSession, roots, include_deleted: bool = True):
    """Index entries, and the records that could not be read."""
    parsed = parse_records(read_documents(spark, roots))
    entries = parsed.where("kind <> 'unreadable'")
    if not include_deleted:
        entries = entries.where("kind = 'session'")
    problems = parsed.where("kind = 'unreadable'").select(
        "index_path", F.lit("unparseable index entry").alias("message")
    )
    return entries, problems


def read_all_records(spark: SparkSession, roots) -> DataFrame:
    """Every record, with or without pointer, readable or not, in any folder."""
    return parse_records(read_documents(spark, roots), strict_folders=False).where("kind <> 'deleted'")


def list_org_folders(spark: SparkSession, roots, folder_times: DataFrame | None = None) -> DataFrame:
    """Organisation folders of every account, empty ones included.

    ``folder_times`` (``dir, created_ms, account_created_ms``) adds birth times
    where the caller knows them.
    """
    entries = list_entries(spark, roots)
    path = F.col("file_path")
    folder = r"^(.*/([^/]+))/([^/]+)$"
    dirs = entries.where("is_dir").select(
        path.alias("dir"), F.regexp_extract(path, folder, 2).alias("account_uuid"),
        F.regexp_extract(path, folder, 3).alias("organization_uuid"),
    ).where(is_uuid(F.col("account_uuid"), True) & is_uuid(F.col("organization_uuid"), True)).distinct()
    return count_org_entries(dirs, entries.where("NOT is_dir").select("file_path"), folder_times)


def count_org_entries(dirs: DataFrame, files: DataFrame, folder_times: DataFrame | None = None) -> DataFrame:
    """Adds session and tombstone counts to organisation folders."""
    name = F.element_at(F.split("file_path", "/"), -1)
    counted = files.select(
        F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1).alias("dir"),
        (F.startswith(name, F.lit("local_")) & F.endswith(name, F.lit(".json"))).alias("_session"),
        F.startswith(name, F.lit("deleted_")).alias("_deleted"),
    ).groupBy("dir").agg(F.count_if("_session").alias("session_count"), F.count_if("_deleted").alias("deleted_count"))
    out = dirs.join(counted, "dir", "left").fillna(0, ["session_count", "deleted_count"])
    if folder_times is not None:
        return out.join(folder_times, "dir", "left")
    null = F.lit(None).cast("long")
    return out.withColumn("created_ms", null).withColumn("account_created_ms", null)


def populated_accounts(folders: DataFrame) -> DataFrame:
    """Folders that hold entries."""
    return folders.where("session_count > 0 OR deleted_count > 0").select(
        "account_uuid", "organization_uuid", "dir", "session_count", "deleted_count"
    )


def parse_identities(documents: DataFrame) -> DataFrame:
    """Identity fields of configuration documents (``file_path, size_bytes, raw``).

    Nothing but identity is selected; documents that are huge, broken or
    without an account give no row.
    """
    small = documents.where(F.col("size_bytes") <= fv.MAX_CONFIG_BYTES)
    opened = parse_lines(small)
    get = lambda name: field(F.col("row"), f"$.oauthAccount.{name}")
    return opened.select(
        "file_path",
        get("accountUuid").alias("account_uuid"), get("organizationUuid").alias("organization_uuid"),
        get("emailAddress").alias("email"), F.coalesce(get("displayName"), get("fullName")).alias("display_name"),
        get("organizationName").alias("organization_name"), get("organizationType").alias("organization_type"),
        text_field(F.col("row"), "$.userID").alias("user_id"),
    )


def harvest_identities(documents: DataFrame) -> DataFrame:
    """First valid identity per account among per-session configuration files.

    The folder names the account; a document that names another is ignored.
    """
    place = r"/([0-9a-fA-F-]{36})/([0-9a-fA-F-]{36})/[^/]+/[^/]+/[^/]+$"
    found = parse_identities(documents).where(is_uuid(F.col("account_uuid"))).where(
        F.regexp_extract("file_path", place, 1) == F.col("account_uuid")
    )
    return first_per(found, ["account_uuid"], "file_path").drop("user_id")


def first_per(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    ranked = frame.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return ranked.where("_n = 1").drop("_n")


def config_identity(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Identity behind each root from its configuration documents.

    ``roots``: ``root, file_path, rank`` (candidate documents in order).  A
    document with an account wins over one that only knows the machine, and
    without either the root is a local profile.
    """
    known = parse_identities(documents).join(roots, "file_path", "right")
    account = F.coalesce("account_uuid", "organization_uuid")
    # Account documents rank before machine documents, each by their order.
    tier = F.when(account.isNotNull(), 0).when(F.col("user_id").isNotNull(), 1).otherwise(2)
    best = first_per(known.withColumn("_order", F.struct(tier, "rank")), ["root"], "_order")
    name = F.element_at(F.split("root", "/"), -1)
    return best.select(
        "root",
        F.coalesce(account, "user_id", name).alias("account_id"), "account_uuid", "organization_uuid", "email",
        F.when(account.isNotNull(), F.coalesce("email", "organization_name", F.substring(account, 1, 12)))
        .when(F.col("user_id").isNotNull(), "machine profile")
        .otherwise(F.concat(F.lit("local profile ("), name, F.lit(")"))).alias("label"),
    )
