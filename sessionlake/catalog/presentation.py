"""Search, sorting, grouping, comparison and audit views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.operators import listing as ls, present
from sessionlake.operators.positions import sorted_place
from sessionlake.plans import store
from sessionlake.session import shared


def _sessions(spark, sf):
    return shared(m.listing(spark, sf)[0].withColumn("uid", F.col("file_path")), "sessions")


def search_sessions(spark, sf):
    """F1, F2."""
    return present.visible(_sessions(spark, sf), "/r", False, "BoLt").select("uid", "title", "project_path")


def flagged_sessions(spark, sf):
    """Sessions with warnings, one row per warning."""
    return present.visible(_sessions(spark, sf), None, True).select("uid", F.explode("warnings").alias("warning"))


def selectable_history(spark, sf):
    """history rows with a transcript behind them."""
    sessions, _ = m.listing(spark, sf)
    rows = ls.account_history(m.index_entries(spark, sf), m.index_accounts(spark, sf), sessions)
    return present.selectable(rows).groupBy("account_uuid").agg(F.count("*").alias("n_rows"))


def sessions_by_title(spark, sf):
    """O2, O3: all by title, in natural order."""
    return sorted_place(present.sort_sessions(_sessions(spark, sf), "title", True).select("uid", "title"))


def sessions_by_title_descending(spark, sf):
    """O2: all by title, last first; untitled sessions stay at the end."""
    return sorted_place(present.sort_sessions(_sessions(spark, sf), "title", False).select("uid", "title"))


def sessions_by_size(spark, sf):
    """O2: all, largest first."""
    return sorted_place(present.sort_sessions(_sessions(spark, sf), "size", False).select("uid", "size_bytes"))


def sessions_by_state(spark, sf):
    """All, worst first."""
    return sorted_place(present.sort_sessions(_sessions(spark, sf), "state", False).select("uid", "integrity"))


def newest_sessions(spark, sf):
    """O1: all, latest first."""
    return sorted_place(present.newest_first(_sessions(spark, sf)).select("uid", "updated_at"))


def project_groups(spark, sf):
    """G19, O5, P20."""
    return sorted_place(present.group_sessions(_sessions(spark, sf), "size"))


def comparison_matrix(spark, sf):
    """Who lists each session."""
    return present.comparison(m.index_entries(spark, sf), m.index_accounts(spark, sf))


def comparison_differences(spark, sf):
    """Sessions not all accounts list, fewest accounts first, then the latest."""
    out = present.only_differences(present.comparison(m.index_entries(spark, sf), m.index_accounts(spark, sf)), 5)
    return sorted_place(present.order_comparison(out).select("key", "n_accounts"))


def listing_columns(spark, sf):
    """One column per account."""
    return present.listing_matrix(m.index_entries(spark, sf), ["ASIA", "EUROPE"])


def shown_messages(spark, sf):
    """First four messages of each conversation, clipped."""
    return present.load_session(m.messages(spark, sf), 4).select("uid", "pos", "role", "text", "total_messages", "truncated")


def audit_tail(spark, sf):
    """Newest two hundred audit events, unreadable ones as placeholders."""
    e = m.table(spark, sf, "events")
    raw = F.concat(F.lit('{"at":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('","action":"'), "event_type", F.lit('","outcome":"u'), "user_id",
                   F.when(F.col("event_type") == "error", F.lit('"')).otherwise(F.lit('"}')))
    return present.read_audit(e.select(F.col("event_id").alias("line_no"), raw.alias("raw"))).drop("session_id")


def audit_counts(spark, sf):
    """G16 over the audit log."""
    e = m.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("who"))
    return store.summarize_plan(e, "who")


def audit_totals(spark, sf):
    """Results per user after the fact."""
    return m.table(spark, sf, "events").select(F.col("event_type").alias("applied")).transform(store.summarize_results)


def selected_entries(spark, sf):
    """Selected uids, and those that are gone."""
    sessions = _sessions(spark, sf)
    picked = m.table(spark, sf, "lineitem").select(F.concat(F.lit("/r/projects/"), "l_suppkey", F.lit("/"), "l_orderkey", F.lit(".jsonl")).alias("uid"))
    found, gone = present.select_entries(sessions, picked)
    return found.select(F.lit("found").alias("part"), "uid").unionByName(gone.select(F.lit("gone").alias("part"), "uid"))


def first_message_problems(spark, sf):
    """First three bad roles per user, roles being event types."""
    from sessionlake.operators import content

    e = m.table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", "user").otherwise(F.col("event_type")).alias("role"), F.lit("text").alias("type"))
    return present.first_problems(content.message_problems(e, ["user_id"]), ["user_id"])


QUERIES = {f.__name__: f for f in (
    search_sessions, flagged_sessions, selectable_history, sessions_by_title, sessions_by_title_descending, sessions_by_size, sessions_by_state,
    newest_sessions, project_groups, comparison_matrix, comparison_differences, listing_columns, shown_messages, audit_tail, audit_counts,
    audit_totals, selected_entries, first_message_problems)}

_LIST = f"WITH {m.LISTING}"
_KEYED = f"{_LIST}, keyed AS (SELECT e.*, coalesce(cli_session_id, 'record:' || desktop_session_id) AS key, r_regionkey AS position FROM index_entries e JOIN region ON r_name = account_uuid WHERE kind = 'session')"
_EVENT = """'{"at":"' || strftime(ts, '%Y-%m-%d') || '","action":"' || event_type || '","outcome":"u' || user_id || '"'"""
SQL = {
    "search_sessions": f"""{_LIST} SELECT file_path AS uid, title, project_path FROM listing WHERE contains(lower(session_id), 'bolt') OR contains(lower(project_path), 'bolt')
        OR contains(lower(model), 'bolt') OR contains(lower(title), 'bolt') OR contains(lower(project_dir), 'bolt')""",
    "flagged_sessions": f"""{_LIST} SELECT file_path AS uid, integrity AS warning FROM listing WHERE integrity <> 'ok'
        UNION ALL SELECT file_path, 'stub' FROM listing WHERE size_bytes > 0 AND size_bytes < 2048 UNION ALL SELECT file_path, 'huge' FROM listing WHERE size_bytes > 268435456""",
    "selectable_history": f"{_LIST} SELECT r.account_uuid, count(*) AS n_rows FROM records r JOIN listing l ON l.session_id = r.cli_session_id GROUP BY 1",
    "sessions_by_title": f"""{_LIST} SELECT file_path AS uid, title, row_number() OVER (ORDER BY title IS NULL, regexp_replace(lower(title), '[0-9]+$', ''), coalesce(try_cast(regexp_extract(title, '[0-9]+$') AS BIGINT), 0), file_path) - 1 AS place FROM listing""",
    "sessions_by_title_descending": f"""{_LIST} SELECT file_path AS uid, title, row_number() OVER (ORDER BY title IS NULL, regexp_replace(lower(title), '[0-9]+$', '') DESC, coalesce(try_cast(regexp_extract(title, '[0-9]+$') AS BIGINT), 0) DESC, file_path) - 1 AS place FROM listing""",
    "sessions_by_size": f"{_LIST} SELECT file_path AS uid, size_bytes, row_number() OVER (ORDER BY size_bytes DESC, file_path) - 1 AS place FROM listing",
    "sessions_by_state": f"{_LIST} SELECT file_path AS uid, integrity, row_number() OVER (ORDER BY CASE integrity WHEN 'ok' THEN 0 WHEN 'truncated' THEN 1 ELSE 3 END DESC, file_path) - 1 AS place FROM listing",
    "newest_sessions": f"{_LIST} SELECT file_path AS uid, updated_at, row_number() OVER (ORDER BY updated_at DESC, file_path) - 1 AS place FROM listing",
    "project_groups": f"""{_LIST} SELECT g AS group_key, CASE WHEN contains(g, '/') THEN regexp_extract(g, '[^/]+$') ELSE g END AS group_label, count(*) AS n_sessions, sum(size_bytes)::BIGINT AS bytes,
        count(*) FILTER (integrity <> 'ok' OR size_bytes < 2048 OR size_bytes > 268435456) AS n_flagged, row_number() OVER (ORDER BY max(size_bytes) DESC, g) - 1 AS place FROM (SELECT *, coalesce(project_path, project_dir) AS g FROM listing) GROUP BY g""",
    "comparison_matrix": f"""{_KEYED} SELECT key, count(DISTINCT account_uuid) AS n_accounts, max(last_activity_at) AS last_activity_at,
        arg_min(title, (position, index_path)) FILTER (title <> '') AS title, arg_min(project_path, (position, index_path)) AS project_path FROM keyed GROUP BY 1""",
    "comparison_differences": f"""{_KEYED} SELECT key, n_accounts, row_number() OVER (ORDER BY n_accounts, latest DESC, key) - 1 AS place
        FROM (SELECT key, count(DISTINCT account_uuid) AS n_accounts, max(last_activity_at) AS latest FROM keyed GROUP BY 1) WHERE n_accounts < 5""",
    "listing_columns": f"""{_KEYED} SELECT key, bool_or(account_uuid = 'ASIA') AS "ASIA", bool_or(account_uuid = 'EUROPE') AS "EUROPE" FROM keyed GROUP BY 1""",
    "shown_messages": """SELECT conv_id AS uid, turn AS pos, role, left(text, 4000) AS text, n AS total_messages, n > 4 AS truncated FROM conversations JOIN
        (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE turn < 4""",
    "audit_tail": f"""SELECT event_id AS line_no, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS at, CASE WHEN event_type = 'error' THEN 'unparseable-audit-line' ELSE event_type END AS action,
        CASE WHEN event_type <> 'error' THEN 'u' || user_id END AS outcome, CASE WHEN event_type = 'error' THEN left({_EVENT}, 200) END AS sample FROM events ORDER BY event_id DESC LIMIT 200""",
    "audit_counts": "SELECT event_type AS kind, count(*) AS n_actions, count(DISTINCT user_id) AS n_targets FROM events GROUP BY 1",
    "audit_totals": "SELECT event_type AS applied, count(*) AS n_actions FROM events GROUP BY 1",
    "selected_entries": f"""{_LIST}, picked AS (SELECT DISTINCT '/r/projects/' || l_suppkey || '/' || l_orderkey || '.jsonl' AS uid FROM lineitem)
        SELECT CASE WHEN uid IN (SELECT file_path FROM listing) THEN 'found' ELSE 'gone' END AS part, uid FROM picked""",
    "first_message_problems": """SELECT user_id, 'role' AS field, event_id AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'view') WHERE n <= 3""",
}
