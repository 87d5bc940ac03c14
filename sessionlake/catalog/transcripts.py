"""Lines, integrity, messages, content identity and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.operators import compare, content, integrity, normalize
from sessionlake.operators.positions import RUN_LENGTH, dense_position, running_total
from sessionlake.session import shared
from sessionlake.sources import jsonl


def _lines(spark, sf):
    return jsonl.classify(m.transcript_lines(spark, sf))


def line_numbers(spark, sf):
    """Every line with number and byte offset."""
    numbered = m.document_lines(spark, sf).withColumn("_bytes", F.octet_length("raw") + F.lit(1).cast("long"))
    numbered = numbered.withColumn("_at", F.col("line_no") - 1)
    summed = running_total(numbered, ["file_path"], "_at", "_bytes", "_end")
    return summed.select("file_path", "line_no", (F.col("_end") - F.col("_bytes")).alias("byte_offset"),
                         F.sha2("raw", 256).alias("line_hash"))


def line_gate(spark, sf):
    """Strict parse gate, per line."""
    return _lines(spark, sf).select("file_path", "line_no", "status")


def document_line_gate(spark, sf):
    """S2 on prose: blank lines, bare numbers, and everything that is not JSON."""
    gated = jsonl.classify(m.document_lines(spark, sf))
    return gated.groupBy("file_path", "status").agg(F.count("*").alias("n_lines"))


def head_rows(spark, sf):
    """S3: first 40 parseable rows per transcript."""
    return jsonl.head_rows(_lines(spark, sf)).select("file_path", "line_no", F.col("head_no").cast("long").alias("head_no"))


def tail_rows(spark, sf):
    """Last eight parseable rows per transcript."""
    return jsonl.tail_rows(_lines(spark, sf)).select("file_path", "line_no", F.col("tail_no").cast("long").alias("tail_no"))


def integrity_report(spark, sf):
    """G1: counters and class per transcript."""
    return integrity.integrity_report(_lines(spark, sf))


def error_list(spark, sf):
    """Bounded error listing with clipped samples."""
    return integrity.error_list(_lines(spark, sf))


def message_table(spark, sf):
    """Normalised messages of the transcripts."""
    return normalize.messages(_lines(spark, sf)).select(
        "file_path", "line_no", "pos", "message_id", "row_uuid", "role", "type", "text", F.substring("msg_digest", 1, 16).alias("msg_hash"))


def unmodelled_rows(spark, sf):
    """P25: rows kept verbatim, counted by type."""
    return normalize.raw_rows(normalize.rows(_lines(spark, sf))).select("file_path", "line_no", "row_type")


def row_type_counts(spark, sf):
    """G3."""
    return normalize.row_type_counts(normalize.rows(_lines(spark, sf)))


def dominant_models(spark, sf):
    """Model of most messages, first seen on ties."""
    return normalize.dominant_model(normalize.models_seen(normalize.rows(_lines(spark, sf))))


def split_turn_dedupe(spark, sf):
    """Repeated lines of a document are repeated blocks of one message."""
    lines = m.document_lines(spark, sf).withColumn("fingerprint", F.sha1("raw"))
    keyed = lines.select("file_path", F.lit("m").alias("message_id"), "fingerprint", "line_no", F.lit(0).alias("block_no"))
    return normalize.drop_repeated_blocks(keyed).select("file_path", "line_no", "fingerprint")


def repeated_blocks(spark, sf):
    """Duplicates collapsed per document."""
    lines = m.document_lines(spark, sf).select("file_path", F.lit("m").alias("message_id"), F.sha1("raw").alias("fingerprint"))
    return normalize.repeated_blocks(lines)


def dense_positions(spark, sf):
    """Positions of the non-blank lines of each document."""
    kept = m.document_lines(spark, sf).where("raw <> ''").select("file_path", "line_no")
    return dense_position(kept, ["file_path"], ["line_no"], F.floor(F.col("line_no") / RUN_LENGTH))


def message_hashes(spark, sf):
    """P5, P6, P8."""
    return m.messages(spark, sf).select("uid", "pos", F.substring("msg_digest", 1, 16).alias("msg_hash"))


def session_hashes(spark, sf):
    """Content digest of every conversation."""
    return content.content_hash(m.messages(spark, sf), ["uid"])


def document_hashes(spark, sf):
    """G5 with every line of a document as one message."""
    lines = m.document_lines(spark, sf).select("doc_id", (F.col("line_no") - 1).alias("pos"), F.sha2("raw", 256).alias("msg_digest"))
    return content.content_hash(lines, ["doc_id"])


def session_summaries(spark, sf):
    """Flagship."""
    msgs = m.messages(spark, sf)
    return content.summarize(msgs, ["uid"]).join(content.content_hash(msgs, ["uid"]).select("uid", "content_hash"), "uid")


def time_bounds(spark, sf):
    """First and last event time per user, from strings."""
    events = m.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"))
    return content.time_bounds(events, ["user_id"])


def duplicate_documents(spark, sf):
    """Contents held more than once, with the number of sources."""
    docs = m.table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    return content.duplicates(docs, "doc_id", "source")


def validation_problems(spark, sf):
    """stored hashes of copy A checked against copy B's messages."""
    frame = m.copies(spark, sf)
    stored = content.content_hash(frame.where("account = 'A'"), ["conv_id"])
    header = stored.select("conv_id", F.lit(1).alias("schema_version"), F.lit("transcript").alias("tool"),
                           F.col("conv_id").cast("string").alias("session_id"), "content_hash")
    return content.validate(header, frame.where("account = 'B'"), ["conv_id"], ("transcript",)).select("conv_id", "field")


def _compared(spark, sf):
    frame = m.copies(spark, sf)
    pairs = m.copy_pairs(frame)
    runs = shared(content.run_digests(frame, ["uid", "account", "conv_id"]), "runs")
    return frame, pairs, compare.compare(pairs, frame, m.copy_sessions(frame, runs), runs)


def compare_copies(spark, sf):
    """J11, W8, D1, D2, P24, A7."""
    out = compare.with_recommendation(_compared(spark, sf)[2])
    return out.select("pair_id", "relation", "common_prefix", "diverge_index", "a_length", "b_length", "a_only", "b_only",
                      "same_hash", "longer", "newer", "recommendation")


def relation_counts(spark, sf):
    """D1 summarised."""
    return _compared(spark, sf)[2].groupBy("relation").agg(F.count("*").alias("n_pairs"), F.sum("common_prefix").alias("shared_messages"))


def diff_preview(spark, sf):
    """W9, D3."""
    frame, _pairs, out = _compared(spark, sf)
    return compare.diff_preview(out, frame).select("pair_id", "part", "pos", "role", "text")


def union_of_copies(spark, sf):
    """Both copies joined after their common beginning, rehashed."""
    frame, pairs, out = _compared(spark, sf)
    merged = content.union_sessions(pairs, frame, out)
    return content.union_hashes(merged, m.copy_sessions(frame), pairs).select("pair_id", "merge_kind", "message_count", "content_hash")


def filled_times(spark, sf):
    """Created and updated times of users' sessions, from their events where absent."""
    events = m.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"))
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user_id"))
    sessions = events.select("user_id").distinct().select(
        "user_id", F.when(F.col("user_id") % 3 == 0, stamp).alias("created_at"), F.when(F.col("user_id") % 2 == 0, stamp).alias("updated_at"))
    return content.fill_times(sessions, content.time_bounds(events, ["user_id"]), ["user_id"]).select("user_id", "created_at", "updated_at")


def pair_summaries(spark, sf):
    """D3: messages and characters of both sides of every pair."""
    frame, _pairs, out = _compared(spark, sf)
    return compare.pair_summaries(out, frame).select("pair_id", "side", "message_count", "user_count", "text_chars")


QUERIES = {f.__name__: f for f in (
    filled_times, pair_summaries, line_numbers, line_gate, document_line_gate, head_rows, tail_rows, integrity_report, error_list, message_table,
    unmodelled_rows, row_type_counts, dominant_models, split_turn_dedupe, repeated_blocks, dense_positions,
    message_hashes, session_hashes, document_hashes, session_summaries, time_bounds, duplicate_documents,
    validation_problems, compare_copies, relation_counts, diff_preview, union_of_copies)}

_COPIES = f"WITH {m.COPIES}, {m.COPY_SESSIONS}, {m.COPY_TIMES}, {m.COPY_COMPARED}"
_ADVICE = ("CASE relation WHEN 'identical' THEN 'skip' WHEN 'prefix' THEN CASE WHEN b_length > a_length THEN 'keep-incoming' "
           "ELSE 'keep-existing' END ELSE 'keep-both' END")
_UNION = """
 merged AS (
  SELECT c.conv_id AS pair_id, CASE WHEN r.relation <> 'prefix' AND account = 'B' THEN pos - common_prefix + a_length ELSE pos END AS pos, msg_digest,
         CASE WHEN r.relation = 'prefix' THEN 'prefix-extend' ELSE 'concatenated-branches' END AS merge_kind
  FROM copies c JOIN compared r ON r.pair_id = c.conv_id
  WHERE CASE WHEN r.relation = 'prefix' THEN account = CASE WHEN b_length > a_length THEN 'B' ELSE 'A' END
        ELSE account = 'A' OR pos >= common_prefix END)"""
_PARSED = f"WITH {m.TRANSCRIPT_LINES}"
_DOCS = f"WITH {m.DOCUMENT_LINES}"

SQL = {
    "filled_times": """SELECT user_id, CASE WHEN user_id % 3 = 0 THEN make_timestamp((1700000000 + user_id) * 1000000) ELSE date_trunc('millisecond', min(ts)) END AS created_at,
        CASE WHEN user_id % 2 = 0 THEN make_timestamp((1700000000 + user_id) * 1000000) ELSE date_trunc('millisecond', max(ts)) END AS updated_at FROM events GROUP BY 1""",
    "pair_summaries": f"""WITH {m.COPIES} SELECT conv_id AS pair_id, lower(account) AS side, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_count,
        sum(length(text))::BIGINT AS text_chars FROM copies GROUP BY 1, 2""",
    "line_numbers": f"""{_DOCS} SELECT file_path, line_no,
        coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
        sha256(raw) AS line_hash FROM doc_lines""",
    "line_gate": f"{_PARSED} SELECT file_path, line_no, status FROM gated",
    "document_line_gate": f"""{_DOCS} SELECT file_path, CASE WHEN regexp_matches(raw, '^\\s*$') THEN 'blank' WHEN json_valid(raw) THEN 'ok' ELSE 'parse' END AS status,
        count(*) AS n_lines FROM doc_lines GROUP BY 1, 2""",
    "head_rows": f"""{_PARSED} SELECT * FROM (SELECT file_path, line_no, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS head_no
        FROM gated WHERE status = 'ok') WHERE head_no <= 40""",
    "tail_rows": f"""{_PARSED} SELECT * FROM (SELECT file_path, line_no, row_number() OVER (PARTITION BY file_path ORDER BY line_no DESC) AS tail_no
        FROM gated WHERE status = 'ok') WHERE tail_no <= 8""",
    "integrity_report": f"""{_PARSED} SELECT file_path, count(*) AS total_lines, count(*) FILTER (status = 'ok') AS parsed_rows,
        0::BIGINT AS blank_lines, count(*) FILTER (status <> 'ok') AS error_count,
        CASE WHEN count(*) FILTER (status <> 'ok') = 0 THEN 'ok'
             WHEN count(*) FILTER (status <> 'ok') = 1 AND count(*) FILTER (status = 'truncated-tail') = 1 THEN 'truncated' ELSE 'damaged' END AS integrity
        FROM gated GROUP BY file_path""",
    "error_list": f"""{_PARSED} SELECT file_path, line_no, status AS kind,
        CASE WHEN length(raw) > 160 THEN left(raw, 80) || ' ... ' || right(raw, 40) ELSE raw END AS sample FROM (
          SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS n FROM gated WHERE status <> 'ok') WHERE n <= 200""",
    "message_table": f"""{_PARSED} SELECT file_path, line_no, row_number() OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS pos,
        'u' || conv_id || '-' || turn AS message_id, 'u' || conv_id || '-' || turn AS row_uuid, role, 'text' AS type, text,
        left(sha256({m.sql_message_json('role', 'text')}), 16) AS msg_hash FROM gated WHERE status = 'ok' AND role <> 'system'""",
    "unmodelled_rows": f"{_PARSED} SELECT file_path, line_no, role AS row_type FROM gated WHERE status = 'ok' AND role = 'system'",
    "row_type_counts": f"{_PARSED} SELECT file_path, role AS row_type, count(*) AS n_rows FROM gated WHERE status = 'ok' GROUP BY 1, 2",
    "dominant_models": f"""{_PARSED} SELECT file_path, model FROM (SELECT file_path, model, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, f) AS k FROM (
        SELECT file_path, 'm' || (length(text) % 3) AS model, count(*) AS n, min(line_no) AS f FROM gated WHERE status = 'ok' AND role <> 'system' GROUP BY 1, 2)) WHERE k = 1""",
    "split_turn_dedupe": f"{_DOCS} SELECT file_path, min(line_no) AS line_no, sha1(raw) AS fingerprint FROM doc_lines GROUP BY file_path, raw",
    "repeated_blocks": f"{_DOCS} SELECT file_path, (count(*) - count(DISTINCT raw))::BIGINT AS duplicate_blocks FROM doc_lines GROUP BY 1",
    "dense_positions": f"{_DOCS} SELECT file_path, line_no, row_number() OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS pos FROM doc_lines WHERE raw <> ''",
    "message_hashes": f"WITH {m.MESSAGES} SELECT uid, pos, left(msg_digest, 16) AS msg_hash FROM messages",
    "session_hashes": f"WITH {m.MESSAGES} {m.sql_content_hash('messages', 'uid')}",
    "document_hashes": f"""{_DOCS}, d AS (SELECT doc_id, line_no - 1 AS pos, sha256(raw) AS msg_digest FROM doc_lines) {m.sql_content_hash('d', 'doc_id')}""",
    "session_summaries": f"""WITH {m.MESSAGES}, h AS ({m.sql_content_hash('messages', 'uid')})
        SELECT s.*, h.content_hash FROM (SELECT uid, count(*) AS message_count,
          count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role = 'assistant') AS assistant_count,
          count(*) FILTER (role = 'system') AS system_count, count(*) FILTER (role = 'tool') AS tool_count,
          sum(length(text))::BIGINT AS text_chars,
          left(arg_min(text, pos) FILTER (role = 'user' AND text <> ''), 200) AS first_user_text FROM messages GROUP BY uid) s JOIN h USING (uid)""",
    "time_bounds": """SELECT user_id, date_trunc('millisecond', min(ts)) AS first_at, date_trunc('millisecond', max(ts)) AS last_at FROM events GROUP BY 1""",
    "duplicate_documents": """SELECT sha256(text) AS content_hash, count(*) AS copies, count(DISTINCT source) AS holders, min(doc_id) AS first_item
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "validation_problems": f"{_COPIES} SELECT pair_id AS conv_id, 'content_hash' AS field FROM compared WHERE relation <> 'identical'",
    "compare_copies": f"""{_COPIES} SELECT pair_id, relation, common_prefix, CASE WHEN relation <> 'identical' THEN common_prefix END AS diverge_index,
        a_length, b_length, a_length - common_prefix AS a_only, b_length - common_prefix AS b_only, relation = 'identical' AS same_hash,
        CASE WHEN a_length > b_length THEN 'a' WHEN b_length > a_length THEN 'b' END AS longer,
        CASE WHEN a.updated_at > b.updated_at THEN 'a' WHEN b.updated_at > a.updated_at THEN 'b' END AS newer,
        {_ADVICE} AS recommendation
        FROM compared LEFT JOIN timed a ON a.uid = 'A-' || pair_id LEFT JOIN timed b ON b.uid = 'B-' || pair_id""",
    "relation_counts": f"{_COPIES} SELECT relation, count(*) AS n_pairs, sum(common_prefix)::BIGINT AS shared_messages FROM compared GROUP BY 1",
    "diff_preview": f"""{_COPIES}, split_at AS (SELECT pair_id, CASE WHEN relation = 'identical' THEN 0 ELSE common_prefix END AS x FROM compared)
        SELECT pair_id, CASE WHEN pos < x THEN 'shared' WHEN account = 'A' THEN 'a_next' ELSE 'b_next' END AS part, pos, role, left(text, 400) AS text
        FROM split_at JOIN copies ON conv_id = pair_id WHERE (account = 'A' AND pos BETWEEN x - 3 AND x + 2) OR (account = 'B' AND pos BETWEEN x AND x + 2)""",
    "union_of_copies": f"""{_COPIES}, {_UNION}, h AS ({m.sql_content_hash('merged', 'pair_id')})
        SELECT h.pair_id, k.merge_kind, h.message_count, h.content_hash FROM h JOIN (SELECT DISTINCT pair_id, merge_kind FROM merged) k USING (pair_id)""",
}
