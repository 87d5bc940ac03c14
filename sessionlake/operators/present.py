"""Views for people: search, sort, group, compare, clip, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions import text as tx
from sessionlake.functions.jsonvalues import field, parse_lines
from sessionlake.functions.text import js_trim

#: Rows of a task where a selection meets the listing, and tasks that share the repeats of one uid.
ROWS_PER_TASK, SALTS = 400_000, 8
SEARCHED = ("session_id", "project_path", "model", "title", "project_dir")


def search(frame: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows with the query in any of the columns, without regard to case."""
    wanted = query.strip().lower()
    if not wanted:
        return frame
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    return frame.where(hit)


def visible(frame: DataFrame, root: str | None = None, only_warnings: bool = False, query: str = "") -> DataFrame:
    """Rows of one root, with warnings, matching the search; each optional."""
    if root is not None:
        frame = frame.where(F.col("root") == root)
    if only_warnings:
        frame = frame.where(F.size("warnings") > 0)
    return search(frame, query)


def selectable(frame: DataFrame) -> DataFrame:
    """Rows that have a transcript to act on."""
    return frame.where(F.coalesce("has_transcript", F.lit(True)))


def sort_value(key: str) -> Column:
    """Value a listing is sorted by.  Text sorts naturally and is null when
    absent; numbers count as zero when absent."""
    text = lambda *c: tx.natural_key(F.nullif(F.coalesce(*c, F.lit("")), F.lit("")))
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    values = {
        "project": lambda: text(present("project_path"), present("project_dir")),
        "title": lambda: text(F.col("title")),
        "model": lambda: text(F.col("model")),
        "size": lambda: F.coalesce(F.col("size_bytes"), F.lit(0)),
        "updated": lambda: F.coalesce(F.unix_micros(tx.parse_instant(F.col("updated_at"))), F.lit(0)),
        "state": lambda: tx.integrity_rank(F.coalesce("integrity", F.lit(""))),
    }
    return values[key]()


def sort_sessions(frame: DataFrame, key: str = "updated", ascending: bool = False, tiebreak: str = "uid") -> DataFrame:
    """Sorted listing; rows without a value come last in both directions."""
    value = sort_value(key)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return frame.orderBy(order, F.col(tiebreak).asc())


def newest_first(frame: DataFrame) -> DataFrame:
    """By the updated time as text, latest first, absent ones last."""
    return frame.orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "uid")


def group_sessions(frame: DataFrame, key: str = "updated", ascending: bool = False) -> DataFrame:
    """Project groups with counts, ordered by the value of their best row."""
    best = F.min if ascending else F.max
    group = tx.group_key(F.col("project_path"), F.col("project_dir"))
    groups = frame.withColumn("group_key", group).groupBy("group_key").agg(
        F.count("*").alias("n_sessions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.count_if(F.size("warnings") > 0).alias("n_flagged"), best(sort_value(key)).alias("_best"),
    )
    order = tx.natural_key(F.col("group_key")) if key == "project" else F.col("_best")
    direction = order.asc_nulls_last() if ascending else order.desc_nulls_last()
    return groups.withColumn("group_label", tx.group_label(F.col("group_key"))).orderBy(direction, "group_key").drop("_best")


def comparison(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per session of any account's history: who lists it, when it was
    last active, its first title.  ``accounts``: ``account_uuid, position``."""
    key = F.when(F.col("cli_session_id") != "", F.col("cli_session_id")).otherwise(F.concat(F.lit("record:"), "desktop_session_id"))
    mine = entries.where("kind = 'session'").join(accounts.select("account_uuid", "position"), "account_uuid")
    order = F.struct("position", "index_path")
    # Per account first, so that counting accounts needs no set of them.
    per_account = mine.groupBy(key.alias("key"), "account_uuid").agg(
        F.max("last_activity_at").alias("last_activity_at"),
        F.min(F.when(F.col("title") != "", F.struct(order.alias("o"), "title"))).alias("t"),
        F.min(F.struct(order.alias("o"), "project_path")).alias("p"),
    )
    return per_account.groupBy("key").agg(
        F.count("*").alias("n_accounts"), F.max("last_activity_at").alias("last_activity_at"),
        F.min("t")["title"].alias("title"), F.min("p")["project_path"].alias("project_path"),
    )


def listing_matrix(entries: DataFrame, accounts: list[str]) -> DataFrame:
    """The comparison with one boolean column per named account."""
    key = F.when(F.col("cli_session_id") != "", F.col("cli_session_id")).otherwise(F.concat(F.lit("record:"), "desktop_session_id"))
    return entries.where("kind = 'session'").groupBy(key.alias("key")).agg(
        *[F.bool_or(F.col("account_uuid") == a).alias(a) for a in accounts])


def only_differences(compared: DataFrame, n_accounts: int) -> DataFrame:
    return compared.where(F.col("n_accounts") < n_accounts)


def order_comparison(compared: DataFrame) -> DataFrame:
    """Fewest accounts first, then the latest activity."""
    return compared.orderBy("n_accounts", F.desc_nulls_last("last_activity_at"), "key")


def load_session(messages: DataFrame, limit: int = fv.MESSAGE_ROWS_SHOWN) -> DataFrame:
    """First messages of each session clipped for display; ``truncated`` says
    that there are more."""
    shown = messages.where(F.col("pos") < limit).select(
        "uid", "pos", "role", "type", "tool_name", F.substring("text", 1, fv.CLIP_DETAIL).alias("text"))
    totals = messages.groupBy("uid").agg(F.count("*").alias("total_messages"))
    return shown.join(totals, "uid").withColumn("truncated", F.col("total_messages") > limit)


def select_entries(sessions: DataFrame, uids: DataFrame, rows_per_task: int = ROWS_PER_TASK):
    """Selected sessions, and selected uids that no longer exist.

    Uids compress well, so partitions of an even number of bytes would hold
    more rows the larger the tables are. Beyond ``rows_per_task`` the number of
    partitions follows the rows. Repeats go in ``SALTS`` different tasks first,
    so that a uid chosen very often doesn't end up whole in one.
    """
    rows = max(uids.count(), sessions.count())
    wanted = uids.select("uid")
    if rows <= rows_per_task:
        wanted = wanted.distinct()
        return sessions.join(wanted, "uid", "left_semi"), wanted.join(sessions.select("uid"), "uid", "left_anti")
    parts = max(rows // rows_per_task + 1, int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = wanted.withColumn("_salt", F.monotonically_increasing_id() % SALTS).repartition(parts, "uid", "_salt").distinct()
    wanted = salted.select("uid").repartition(parts, "uid").distinct()
    placed = sessions.repartition(parts, "uid")
    return placed.join(wanted, "uid", "left_semi"), wanted.join(placed.select("uid"), "uid", "left_anti")


def read_audit(lines: DataFrame, limit: int = fv.AUDIT_ROWS, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Newest audit events; a line that cannot be read becomes a placeholder.

    The newest non-blank lines are found first and only they are parsed.
    """
    filled = lines.where(js_trim(F.col("raw")) != "")
    newest = filled.orderBy(*[F.desc(c) for c in order]).limit(limit)
    opened = parse_lines(newest)
    row, broken = F.col("row"), F.col("row").isNull()
    return opened.select(
        *order, field(row, "$.at").alias("at"),
        F.when(broken, "unparseable-audit-line").otherwise(field(row, "$.action")).alias("action"),
        field(row, "$.session_id").alias("session_id"), field(row, "$.outcome").alias("outcome"),
        F.when(broken, F.substring(js_trim(F.col("raw")), 1, 200)).alias("sample"),
    )


def first_problems(problems: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """First few problems per session, as shown in error messages."""
    order = W.partitionBy(*keys).orderBy(F.asc_nulls_first("position"), "field")
    return problems.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


# Columns of the previews.
BRIEF_ACCOUNT = ("account_uuid", "label", "is_current", "history_org", "history_dir", "session_count", "ambiguous", "reason")
BROKEN_SUMMARY = ("index_path", "account_uuid", "title", "worktree_cwd", "missing_pointer", "missing_cwd")


def project(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a preview that the frame has."""
    return frame.select(*[c for c in columns if c in frame.columns])
