"""Snapshots and native rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.operators import integrity, normalize
from sessionlake.plans import importing
from sessionlake.session import shared, shared_dir
from sessionlake.sinks import native, snapshot
from sessionlake.sources import jsonl


def _exported(spark, sf):
    """The transcripts of the conversations written as a snapshot."""
    lines = shared(m.transcript_lines(spark, sf).withColumn("uid", F.col("file_path")), "snapshot-lines")
    gated = jsonl.classify(lines)
    states = integrity.integrity_report(gated).select("file_path", "integrity")
    sizes = lines.groupBy("uid", "file_path").agg(F.sum(F.octet_length("raw") + 1).alias("size_bytes"))
    null = F.lit(None).cast("string")
    sessions = shared(sizes.join(states, "file_path").select(
        "uid", "file_path", F.lit("/p").alias("root"), F.regexp_extract("file_path", "([0-9]+)", 1).alias("session_id"), F.lit("t").alias("tool"),
        null.alias("project_path"), null.alias("model"), null.alias("title"), "size_bytes", null.alias("created_at"), null.alias("updated_at"), "integrity"), "snapshot-sessions")
    messages = normalize.messages(gated).withColumn("uid", F.col("file_path"))
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    manifest = snapshot.export_snapshot(path, sessions, messages, lines.select("uid", "line_no", "raw"))
    return path, manifest, sessions


def snapshot_manifest(spark, sf):
    """What a snapshot says about every session."""
    return _exported(spark, sf)[1].select(
        F.col("snapshot_uid").alias("uid"), "session_id", "original_relative", "archive_name", "content_hash", "message_count",
        "raw_digest", "n_lines", "raw_size", "integrity", "has_warning")


def snapshot_messages(spark, sf):
    """Messages read back from a snapshot."""
    return snapshot.load_normalized(spark, _exported(spark, sf)[0]).select("uid", "pos", "role", "text")


def snapshot_restore(spark, sf):
    """A snapshot restored into an empty place, digests checked first."""
    path, manifest, sessions = _exported(spark, sf)
    raw = snapshot.load_raw(spark, path)
    empty = sessions.where(F.lit(False)).select(
        "uid", F.lit("t").alias("dest_tool"), "session_id", "file_path", "size_bytes", F.lit("").alias("content_hash"), F.lit(0).cast("long").alias("message_count"),
        F.lit(None).cast("timestamp").alias("updated_at"))
    roots = spark.createDataFrame([("t", "/new")], "dest_tool string, root string")
    files = empty.select("file_path", F.lit("").alias("raw_digest"))
    plan = importing.plan_import(manifest, roots, empty, spark.read.parquet(f"{path}/messages"), files)
    checked = snapshot.check_restored(manifest, raw, sessions.select("uid", "integrity"))
    none = plan.where(F.lit(False)).select("manifest_index", F.lit("").alias("resolution"))
    done = importing.decide(plan, manifest, none, files.select("file_path"), None, checked)
    target = raw.where(F.lit(False)).select(F.lit("").alias("file_path"), "line_no", "raw")
    after, _ = importing.apply_to_files(done, raw.withColumnRenamed("uid", "snapshot_uid"), target)
    return after.groupBy("file_path").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("raw")).cast("long").alias("n_bytes"))


def native_rows(spark, sf):
    """Conversations as native rows."""
    msgs = m.messages(spark, sf).withColumn("row_uuid", F.lit(None).cast("string")).withColumn("ts", F.lit(None).cast("string"))
    null = F.lit(None).cast("string")
    sessions = msgs.select("uid").distinct().select("uid", F.col("uid").cast("string").alias("session_id"), F.lit("/w").alias("project_path"), null.alias("model"), null.alias("git_branch"))
    rows = native.build_rows(msgs, sessions, F.lit("2026-01-01T00:00:00.000Z"))
    get = lambda p: F.get_json_object("row_json", p)
    return rows.select("uid", "row_no", get("$.type").alias("type"), F.coalesce(get("$.message.content[0].text"), get("$.content")).alias("text"),
                       get("$.sessionId").alias("session_id"), get("$.parentUuid").isNull().alias("is_first"))


def native_round_trip(spark, sf):
    """K3 against A4: rows written natively parse back to the same messages."""
    rows = native_rows_raw(spark, sf)
    lines = jsonl.classify(rows)
    return normalize.messages(lines).groupBy("file_path").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))


def native_rows_raw(spark, sf):
    """Native rows as numbered lines of one file per conversation."""
    msgs = m.messages(spark, sf).withColumn("row_uuid", F.lit(None).cast("string")).withColumn("ts", F.lit(None).cast("string"))
    null = F.lit(None).cast("string")
    sessions = msgs.select("uid").distinct().select("uid", F.col("uid").cast("string").alias("session_id"), F.lit("/w").alias("project_path"), null.alias("model"), null.alias("git_branch"))
    rows = native.build_rows(msgs, sessions, F.lit("2026-01-01T00:00:00.000Z"))
    return rows.select(F.concat(F.lit("/n/"), "uid").alias("file_path"), (F.col("row_no") + 1).alias("line_no"), F.col("row_json").alias("raw"))


QUERIES = {f.__name__: f for f in (snapshot_manifest, snapshot_messages, snapshot_restore, native_rows, native_round_trip)}

_PARSED = f"WITH {m.TRANSCRIPT_LINES}"
_MSGS = (f"{_PARSED}, msgs AS (SELECT file_path AS uid, row_number() OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS pos, role, text, "
         f"sha256({m.sql_message_json('role', 'text')}) AS msg_digest FROM gated WHERE status = 'ok' AND role <> 'system'), "
         "rawd AS (SELECT file_path AS uid, line_no - 1 AS pos, sha256(raw) AS msg_digest FROM gated), "
         "state AS (SELECT file_path AS uid, min(conv_id)::VARCHAR AS session_id, sum(strlen(raw) + 1)::BIGINT AS raw_size, count(*) AS n_lines, sum(strlen(raw))::BIGINT AS n_bytes, "
         "CASE WHEN count(*) FILTER (status <> 'ok') = 0 THEN 'ok' WHEN count(*) FILTER (status <> 'ok') = 1 AND count(*) FILTER (status = 'truncated-tail') = 1 "
         "THEN 'truncated' ELSE 'damaged' END AS integrity FROM gated GROUP BY 1)")
SQL = {
    "snapshot_manifest": f"""{_MSGS}, h AS ({m.sql_content_hash('msgs', 'uid')}), r AS ({m.sql_content_hash('rawd', 'uid')})
        SELECT s.uid, s.session_id, s.session_id || '.jsonl' AS original_relative, 'raw/t/' || s.session_id || '.jsonl' AS archive_name,
        coalesce(h.content_hash, 'sha256:' || sha256('session-v1' || chr(10))) AS content_hash, coalesce(h.message_count, 0) AS message_count,
        r.content_hash AS raw_digest, s.n_lines, s.raw_size, s.integrity, s.integrity = 'damaged' AS has_warning FROM state s LEFT JOIN h USING (uid) LEFT JOIN r USING (uid)""",
    "snapshot_messages": f"{_MSGS} SELECT uid, pos, role, text FROM msgs",
    "snapshot_restore": f"{_MSGS} SELECT '/new/' || session_id || '.jsonl' AS file_path, n_lines, n_bytes FROM state WHERE integrity <> 'damaged'",
    "native_rows": """WITH s AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 1 END AS st FROM conversations),
        r AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_no FROM s)
        SELECT conv_id AS uid, row_no::BIGINT AS row_no, min(role) AS type, arg_min(text, turn) AS text, conv_id::VARCHAR AS session_id, row_no = 0 AS is_first FROM r GROUP BY conv_id, row_no""",
    "native_round_trip": "SELECT '/n/' || conv_id AS file_path, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE role <> 'system' GROUP BY 1",
}
