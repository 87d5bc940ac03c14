"""Queries that read files: the supplied tables are written as transcripts,
sidecars and index records to the shared folder and read by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.functions import text as tx
from sessionlake.functions.jsonvalues import quoted
from sessionlake.operators import accounts, integrity, listing as ls, normalize
from sessionlake.plans import importing, relink
from sessionlake.session import shared_dir
from sessionlake.sinks.files import write_files
from sessionlake.sources import ends, index_files, inventory, jsonl


def _uuid_of(value):
    h = F.md5(value)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _pieces(spark, sf):
    """Transcripts of the conversations, empty and blank ones of customers, sub-agents and sidecars.

    A transcript of a conversation whose id ends in 3 has a byte order mark,
    one in 4 ends lines with both characters, one in 5 has a blank line after
    the first; the last line never ends.
    """
    lines = m.transcript_lines(spark, sf)
    digit, rel = F.col("conv_id") % 10, F.concat(F.lit("root/projects/p"), F.col("conv_id") % 5, F.lit("/"), "conv_id")
    end = F.when(F.col("line_no") == F.col("total_lines"), "").when(digit == 4, "\r\n").otherwise("\n")
    mark = F.when((digit == 3) & (F.col("line_no") == 1), "﻿").otherwise("")
    blank = F.when((digit == 5) & (F.col("line_no") == 1) & (F.col("total_lines") > 1), " \t\n").otherwise("")
    main = lines.select(F.concat(rel, F.lit(".jsonl")).alias("rel_path"), F.col("line_no").alias("n"), F.concat(mark, "raw", end, blank).alias("value"))
    once = lines.where("line_no = 1")
    below = F.when(F.col("conv_id") % 6 == 0, F.array(F.lit("agent"), F.lit("journal"))).otherwise(F.array(F.lit("agent")))
    agents = once.where(F.col("conv_id") % 3 == 0).select("conv_id", "line_no", F.explode(below).alias("name")).select(
        F.concat(rel, F.lit("/subagents/workflows/w/"), "name", F.lit(".jsonl")).alias("rel_path"), F.col("line_no").alias("n"), F.lit("{}\n").alias("value"))
    todos = once.where(F.col("conv_id") % 4 == 0).select(
        F.concat(F.lit("root/todos/"), "conv_id", F.lit("-agent.json")).alias("rel_path"), F.col("line_no").alias("n"), F.lit("[]").alias("value"))
    history = once.where(F.col("conv_id") % 8 == 0).select(
        F.concat(F.lit("root/file-history/"), "conv_id", F.lit("/v1")).alias("rel_path"), F.col("line_no").alias("n"), F.repeat(F.lit("x"), F.col("conv_id").cast("int")).alias("value"))
    # Customers in debt never wrote a line; those with more than 9000 wrote blanks only.
    odd = m.table(spark, sf, "customer").where("c_acctbal < 0 OR c_acctbal > 9000").select(
        F.concat(F.lit("root/projects/c/c"), "c_custkey", F.lit(".jsonl")).alias("rel_path"), F.lit(1).cast("long").alias("n"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("\n \n").alias("value"))
    return main.unionByName(agents).unionByName(todos).unionByName(history).unionByName(odd)


def _written(spark, sf, pieces=None):
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_files(_pieces(spark, sf) if pieces is None else pieces, ["n"], base)
    return base


def _rel(path="file_path"):
    return F.regexp_replace(path, "^.*/corpus-[0-9a-f]+/", "")


def file_lines(spark, sf):
    """Number, status and digest of every line of the files."""
    lines = jsonl.read_jsonl(spark, f"{_written(spark, sf)}/root/projects")
    return lines.select(_rel().alias("file"), "line_no", "status", F.sha2("raw", 256).alias("line_hash"), "total_lines", "last_line_terminated", "has_bom")


def file_offsets(spark, sf):
    """Byte offset of every line that holds a k."""
    found = jsonl.byte_offsets(jsonl.scan(spark, f"{_written(spark, sf)}/root/projects"), F.contains("raw", F.lit("k")))
    return found.select(_rel().alias("file"), "line_no", "byte_offset")


def file_inventory(spark, sf):
    """Transcripts, agents and journals with size and parent."""
    return inventory.list_transcripts(spark, f"{_written(spark, sf)}/root").select(
        _rel().alias("file"), "kind", "project_dir", "file_session_id", "parent_session_id", "workflow_id", "size_bytes")


def file_sidecars(spark, sf):
    """Sidecars of every session, and how many files go with it."""
    base = _written(spark, sf)
    files = inventory.list_files(spark, f"{base}/root")
    listed = inventory.classify_paths(files)
    sessions = listed.where("kind = 'main'").select("root", F.col("file_session_id").alias("session_id"))
    side = inventory.attach_sidecars(inventory.classify_sidecars(files), sessions).select("session_id", "kind", _rel().alias("file"), "size_bytes")
    below = listed.where("kind <> 'main'").select(F.col("parent_session_id").alias("session_id"), "kind", _rel().alias("file"), "size_bytes")
    return side.unionByName(below)


def file_integrity(spark, sf):
    """G1, A5: verification of the files in one pass, empty and blank ones too."""
    root = f"{_written(spark, sf)}/root/projects"
    report = integrity.verify(spark, root, inventory.list_transcripts(spark, root))
    return report.select(_rel().alias("file"), "size_bytes", "total_lines", "parsed_rows", "blank_lines", "error_count", "last_line_terminated", "integrity")


def file_bytes(spark, sf):
    """Digests of the files' bytes by ranges of 1 000, as written."""
    return inventory.file_digests(spark, f"{_written(spark, sf)}/root", range_bytes=1000).select(_rel().alias("file"), "size_bytes", "sha256")


def file_ends(spark, sf):
    """First 40 and last 8 rows of the files, found by seeking."""
    root = f"{_written(spark, sf)}/root/projects"
    found = ends.read_ends(inventory.list_transcripts(spark, root))
    per = found.groupBy("file_path").agg(
        F.count_if(F.col("part") == "head").alias("n_head"), F.count_if(F.col("part") == "tail").alias("n_tail"),
        F.min_by(F.sha2("raw", 256), F.when(F.col("part") == "head", F.col("line_no"))).alias("first_hash"),
        F.max_by(F.sha2("raw", 256), F.when(F.col("part") == "tail", F.col("line_no"))).alias("last_hash"))
    return per.select(_rel().alias("file"), "n_head", "n_tail", "first_hash", "last_hash")


def file_listing(spark, sf):
    """Listing from the files' ends; a file that is gone by then is a row too."""
    base = _written(spark, sf)
    listed = inventory.list_transcripts(spark, f"{base}/root").where("kind = 'main'")
    gone = m.table(spark, sf, "supplier").select(
        F.concat(F.lit(f"{base}/root/projects/s/"), "s_suppkey", F.lit(".jsonl")).alias("file_path"), F.lit(f"{base}/root").alias("root"), F.lit("s").alias("project_dir"),
        F.col("s_suppkey").cast("string").alias("file_session_id"), F.lit("main").alias("kind"), F.lit(None).cast("string").alias("parent_session_id"),
        F.lit(None).cast("string").alias("workflow_id"), F.lit(5).cast("long").alias("size_bytes"), F.lit(0).cast("timestamp").alias("mtime"))
    both = listed.unionByName(gone)
    found = ends.read_ends(both)
    broken = found.where("part = 'error'").select("file_path")
    meta = ls.sampled_meta(found, both.join(broken, "file_path", "left_anti"))
    failed = ls.error_entries(both, meta, "t")
    columns = lambda f: f.select(_rel().alias("file"), "session_id", "project_path", "model", "size_bytes", "state")
    return columns(meta.withColumn("state", F.lit("read"))).unionByName(columns(failed.withColumn("project_path", F.lit(None).cast("string")).withColumn(
        "model", F.lit(None).cast("string")).withColumn("state", F.concat_ws(":", "integrity", F.col("warnings")[0]))))


def _index_pieces(spark, sf):
    """Suppliers as index records: the region is the account, the nation the
    organisation; those in debt left a tombstone, some records are broken."""
    placed = (m.table(spark, sf, "supplier").join(m.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(m.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    folder = F.concat(F.lit("index/"), _uuid_of("r_name"), F.lit("/"), _uuid_of("n_name"))
    record = F.concat(
        F.lit('{"sessionId":"local_'), "s_suppkey", F.lit('","cliSessionId":'), quoted(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey").cast("string"))), F.lit(',"title":'), quoted(F.col("s_name")),
        F.lit(',"cwd":"/w/'), "s_nationkey", F.lit('","isArchived":'), (F.col("s_suppkey") % 2 == 0).cast("string"), F.lit(',"lastActivityAt":'), F.col("s_suppkey") * 1000, F.lit(',"zz":{"kept":[1,null,"'), "s_name", F.lit('"]}}'))
    debt = F.col("s_acctbal") < 0
    name = F.when(debt, F.concat(F.lit("deleted_"), "s_suppkey")).otherwise(F.concat(F.lit("local_"), "s_suppkey", F.lit(".json")))
    value = F.when(debt, (F.col("s_suppkey") * 1000).cast("string")).when(F.col("s_suppkey") % 7 == 0, F.left(record, F.lit(20))).otherwise(record)
    return placed.select(F.concat(folder, F.lit("/"), name).alias("rel_path"), F.lit(1).alias("n"), value.alias("value"))


def index_documents(spark, sf):
    """Index records and tombstones read from their files."""
    base = _written(spark, sf, _index_pieces(spark, sf))
    entries, problems = index_files.read_index(spark, f"{base}/index")
    columns = ("kind", "account_uuid", "desktop_session_id", "cli_session_id", "title", "worktree_cwd", "is_archived")
    bad = problems.select(F.lit("unreadable").alias("kind"), F.element_at(F.split("index_path", "/"), -3).alias("account_uuid"),
                          F.regexp_extract("index_path", r"([^/]+)\.json$", 1).alias("desktop_session_id"), F.lit(False).alias("is_archived"))
    return entries.select(*columns, F.unix_millis(F.coalesce("last_activity_at", "deleted_at")).alias("at_ms")).unionByName(bad, True)


def repaired_records(spark, sf):
    """Records with their pointer filled in, written as files; fields nobody models stay."""
    base = _written(spark, sf, _index_pieces(spark, sf))
    records = index_files.read_all_records(spark, f"{base}/index").where("kind = 'session'")
    broken = relink.broken_records(records)
    number = F.regexp_extract("desktop_session_id", "[0-9]+", 0)
    plan = broken.select(
        F.lit("repair").alias("kind"), "index_path", "title", F.concat(F.lit("found-"), number).alias("set_cli_session_id"),
        F.concat(F.lit("/new/"), number).alias("set_cwd"), F.concat(F.lit("/t/"), number).alias("transcript"))
    there = m.table(spark, sf, "supplier").where("s_suppkey % 8 <> 0").select(F.concat(F.lit("/t/"), "s_suppkey").alias("file_path"))
    after, _outcomes, _backup = relink.apply_repair(plan, records, there)
    after = after.select(F.concat(F.lit("out/"), F.element_at(F.split("index_path", "/"), -1)).alias("rel_path"), F.lit(1).alias("n"), F.col("record_json").alias("value"))
    out = _written(spark, sf, after)
    return index_files.read_documents(spark, f"{out}/out").select(_rel().alias("file"), F.col("raw").alias("record"))


def organisation_folders(spark, sf):
    """Organisation folders that hold entries."""
    base = _written(spark, sf, _index_pieces(spark, sf))
    return index_files.populated_accounts(index_files.list_org_folders(spark, f"{base}/index")).select(
        "account_uuid", "organization_uuid", "session_count", "deleted_count")


def block_messages(spark, sf):
    """Text, thinking, tool, image and unknown blocks, with results shown beside their row."""
    t = m.table(spark, sf, "conversations")
    q, k = quoted(F.col("text")), F.col("turn") % 6
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":"t1","content":[{"type":"text","text":'), q, F.lit('},{"type":"image"},{"type":"text","text":"z"}]}'))
    block = (F.when(k == 0, F.concat(F.lit('{"type":"text","text":'), q, F.lit("}"))).when(k == 1, F.concat(F.lit('{"type":"thinking","thinking":'), q, F.lit("}")))
             .when(k == 2, F.concat(F.lit('{"type":"tool_use","name":"Read","input":{"b":1,"a":'), q, F.lit("}}"))).when(k == 3, result)
             .when(k == 4, F.lit('{"type":"image","source":{"type":"base64","media_type":"image/png"}}')).otherwise(F.concat(F.lit('{"type":"new-kind","v":'), q, F.lit("}"))))
    empty = F.concat(F.lit('{"type":"tool_result","content":null}'))
    raw = F.concat(F.lit('{"type":"'), F.when(F.col("role") == "assistant", "assistant").otherwise("user"), F.lit('","message":{"role":"'), "role", F.lit('","content":['),
                   block, F.lit(","), block, F.lit(',"skipped",7,'), empty, F.lit(']},"toolUseResult":{"n":'), "turn", F.lit("}}"))
    lines = jsonl.classify(t.select(F.concat(F.lit("c"), "conv_id").alias("file_path"), (F.col("turn") + 1).alias("line_no"), raw.alias("raw")))
    parsed = normalize.rows(lines)
    kept = normalize.drop_repeated_blocks(normalize.blocks(parsed))
    shown = normalize.tool_result_backfill(parsed, kept)
    return shown.select("file_path", "line_no", F.col("block_no").cast("long").alias("block_no"), "message_id", "role", "type", "text", "tool_name", "tool_input", "tool_output")


def account_list(spark, sf):
    """Every account with its folder, records, transcripts and name, in order."""
    entries = m.index_entries(spark, sf)
    sessions, claims = m.listing(spark, sf)
    folders = entries.groupBy("account_uuid", "organization_uuid").agg(
        F.count_if(F.col("kind") == "session").alias("session_count"), F.count_if(F.col("kind") == "deleted").alias("deleted_count")).select(
        "*", F.concat(F.lit("/idx/"), "account_uuid", F.lit("/"), "organization_uuid").alias("dir"), F.lit(None).cast("long").alias("created_ms"), F.lit(None).cast("long").alias("account_created_ms"))
    region = m.table(spark, sf, "region")
    signed = region.where("r_regionkey = 1").select(F.col("r_name").alias("account_uuid"), F.lit("main").alias("organization_uuid"))
    resolved = accounts.resolve_history(folders, signed)
    name = lambda where: region.where(where).select(F.col("r_name").alias("account_uuid"), F.concat(F.lower("r_name"), F.lit("@x")).alias("email"),
                                                    F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("organization_name"))
    custom = region.where("r_regionkey = 3").select(F.col("r_name").alias("account_uuid"), F.lit("mine").alias("label"))
    described = accounts.describe_accounts(resolved.select("account_uuid"), custom, name("r_regionkey < 3"), name("r_regionkey = 1"))
    out = ls.listed_accounts(resolved, described, accounts.summarize_index(entries), sessions, ls.session_claims(sessions, claims))
    return out.select("account_uuid", "label", "label_source", "is_current", "history_org", "ambiguous", "reason", "session_count", "deleted_count",
                      "with_transcript", "transcripts", "exclusive", "bytes", "last_at", F.col("place").cast("long").alias("place"))


def migrated_sessions(spark, sf):
    """Accounts of imported sessions become the destination's; damaged ones are no source."""
    orders = m.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("tool"), F.col("o_custkey").cast("string").alias("account_id"), F.col("o_orderstatus").alias("s"))
    tools = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    remap = m.table(spark, sf, "region").where("r_regionkey < 3").select(
        F.element_at(tools, F.col("r_regionkey").cast("int") + 1).alias("tool"), F.col("r_name").alias("dest_account_id"))
    state = F.when(F.col("s") == "P", "damaged").when(F.col("s") == "F", "truncated").otherwise("ok")
    moved = importing.remap_accounts(orders.withColumn("integrity", state), remap)
    usable = moved.where(tx.is_usable(F.col("integrity")))
    return usable.select("uid", "tool", tx.require_usable(F.col("integrity"), F.col("account_id")).alias("account_id"), "integrity")


def long_lines(spark, sf):
    """The longest text of every language, repeated beyond the parser's limit, as message of one line."""
    longest = m.table(spark, sf, "documents").groupBy("lang").agg(F.max(F.struct("n_chars", "doc_id", "text")).alias("d")).select("lang", "d.*")
    times = F.floor(F.lit(20_500_000) / F.length("text")).cast("int") + 1
    raw = F.concat(F.lit('{"type":"user","uuid":"u'), "doc_id", F.lit('","message":{"role":"user","content":['), F.lit('{"type":"text","text":'), quoted(F.repeat("text", times)),
                   F.lit('},{"type":"tool_use","name":"n","input":'), F.repeat(F.lit("7"), 1500), F.lit("}]}}"))
    lines = jsonl.classify(longest.select(F.concat(F.lit("l-"), "lang").alias("file_path"), F.lit(1).cast("long").alias("line_no"), raw.alias("raw")))
    return normalize.messages(lines).select("file_path", "pos", "row_uuid", "type", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (
    file_lines, file_offsets, file_inventory, file_sidecars, file_integrity, file_bytes, file_ends, file_listing, index_documents, repaired_records,
    organisation_folders, block_messages, account_list, migrated_sessions, long_lines)}

_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
# Every file of the corpus with its lines (and what ends them).
_FILES = (
    f"WITH {m.TRANSCRIPT_LINES}, "
    "main_lines AS (SELECT conv_id, 'root/projects/p' || (conv_id % 5) || '/' || conv_id || '.jsonl' AS file, line_no * 2 AS n, raw, status, total_lines, role, text, turn, "
    "CASE WHEN line_no = total_lines THEN '' WHEN conv_id % 10 = 4 THEN chr(13) || chr(10) ELSE chr(10) END AS ending FROM gated), "
    "all_lines AS (SELECT file, n, raw, status, ending, conv_id, text FROM main_lines UNION ALL "
    "SELECT file, 3, ' ' || chr(9), 'blank', chr(10), conv_id, NULL FROM main_lines WHERE conv_id % 10 = 5 AND n = 2 AND total_lines > 1 UNION ALL "
    "SELECT 'root/projects/c/c' || c_custkey || '.jsonl', unnest([2, 4]), unnest(['', ' ']), 'blank', chr(10), NULL, NULL FROM customer WHERE c_acctbal > 9000 UNION ALL "
    "SELECT 'root/projects/p' || (conv_id % 5) || '/' || conv_id || '/subagents/workflows/w/' || a || '.jsonl', 2, '{}', 'ok', chr(10), NULL, NULL FROM (SELECT DISTINCT conv_id FROM conversations), "
    "(SELECT unnest(['agent', 'journal']) AS a) WHERE conv_id % 3 = 0 AND (a = 'agent' OR conv_id % 6 = 0)), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n) AS line_no, count(*) OVER (PARTITION BY file) AS total_lines, "
    "CASE WHEN conv_id % 10 = 3 THEN 3 ELSE 0 END AS mark, strlen(raw) + strlen(ending) AS n_bytes, last_value(ending) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <> '' AS terminated FROM all_lines), "
    "bytes AS (SELECT file, string_agg(CASE WHEN mark = 3 AND line_no = 1 THEN chr(65279) ELSE '' END || raw || ending, '' ORDER BY line_no) AS content FROM numbered GROUP BY file "
    "UNION ALL SELECT 'root/projects/c/c' || c_custkey || '.jsonl', '' FROM customer WHERE c_acctbal < 0), "
    "sides AS (SELECT conv_id::VARCHAR AS session_id, 'todo' AS kind, 'root/todos/' || conv_id || '-agent.json' AS file, '[]' AS content FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 0 "
    "UNION ALL SELECT conv_id::VARCHAR, 'file-history', 'root/file-history/' || conv_id || '/v1', repeat('x', conv_id::INT) FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 8 = 0)"
)
_INDEX = (
    f"WITH placed AS (SELECT s.*, {_UUID.format('md5(r_name)')} AS account_uuid, {_UUID.format('md5(n_name)')} AS org FROM supplier s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
)
_CHILD = "regexp_matches(file, '/subagents/')"
SQL = {
    "file_lines": f"{_FILES} SELECT file, line_no, status, sha256(raw) AS line_hash, total_lines, terminated AS last_line_terminated, mark = 3 AS has_bom FROM numbered",
    "file_offsets": f"""{_FILES}, o AS (SELECT *, mark + coalesce(sum(n_bytes) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM numbered)
        SELECT file, line_no, o::BIGINT AS byte_offset FROM o WHERE contains(raw, 'k')""",
    "file_inventory": f"""{_FILES} SELECT file, CASE WHEN NOT {_CHILD} THEN 'main' WHEN contains(file, 'journal') THEN 'journal' ELSE 'agent' END AS kind, string_split(file, '/')[3] AS project_dir,
        regexp_extract(file, '([^/]+)\\.jsonl$', 1) AS file_session_id, CASE WHEN {_CHILD} THEN string_split(file, '/')[4] END AS parent_session_id,
        CASE WHEN {_CHILD} THEN 'w' END AS workflow_id, strlen(content) AS size_bytes FROM bytes""",
    "file_sidecars": f"""{_FILES} SELECT s.session_id, s.kind, s.file, strlen(s.content) AS size_bytes FROM (
          SELECT t.session_id, s.kind, s.file, s.content FROM sides s JOIN (SELECT DISTINCT conv_id::VARCHAR AS session_id FROM conversations UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000) t
          ON CASE WHEN s.kind = 'todo' THEN starts_with(s.session_id || '-agent.json', t.session_id) ELSE s.session_id = t.session_id END
          UNION ALL SELECT string_split(file, '/')[4], CASE WHEN contains(file, 'journal') THEN 'journal' ELSE 'agent' END, file, content FROM bytes WHERE {_CHILD}) s""",
    "file_integrity": f"""{_FILES}, r AS (SELECT file, count(*) AS total_lines, count(*) FILTER (status = 'ok') AS parsed_rows, count(*) FILTER (status = 'blank') AS blank_lines,
          count(*) FILTER (status NOT IN ('ok', 'blank')) AS error_count, count(*) FILTER (status = 'truncated-tail') AS tails, any_value(terminated) AS t FROM numbered GROUP BY 1)
        SELECT file, strlen(content) AS size_bytes, coalesce(total_lines, 0) AS total_lines, coalesce(parsed_rows, 0) AS parsed_rows, coalesce(blank_lines, 0) AS blank_lines,
        coalesce(error_count, 0) AS error_count, coalesce(t, true) AS last_line_terminated, CASE WHEN coalesce(total_lines = blank_lines, true) THEN 'empty' WHEN error_count = 0 THEN 'ok'
        WHEN error_count = 1 AND tails = 1 THEN 'truncated' ELSE 'damaged' END AS integrity FROM bytes LEFT JOIN r USING (file)""",
    "file_bytes": f"""{_FILES}, every AS (SELECT file, encode(content) AS b FROM bytes UNION ALL SELECT file, encode(content) FROM sides),
        parts AS (SELECT file, octet_length(b) AS size_bytes, list_transform(range(greatest((octet_length(b) + 999) // 1000, 1)), lambda i: sha256(from_hex(substr(hex(b), i * 2000 + 1, 2000)))) AS d FROM every)
        SELECT file, size_bytes, CASE WHEN len(d) = 1 THEN 'sha256:' || d[1] ELSE 'tree:' || sha256(array_to_string(d, '')) END AS sha256 FROM parts""",
    "file_ends": f"""{_FILES}, k AS (SELECT file, raw, row_number() OVER (PARTITION BY file ORDER BY line_no) AS i, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS j FROM numbered WHERE status = 'ok')
        SELECT file, count(*) FILTER (i <= 40) AS n_head, count(*) FILTER (j <= 8) AS n_tail, sha256(any_value(raw) FILTER (i = 1)) AS first_hash, sha256(any_value(raw) FILTER (j = 1)) AS last_hash FROM k GROUP BY file""",
    "file_listing": f"""{_FILES}, k AS (SELECT file, conv_id, text, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) AS i FROM numbered WHERE status = 'ok' AND NOT {_CHILD}),
        meta AS (SELECT file, any_value(conv_id)::VARCHAR AS session_id, '/work/' || any_value(left(text, 2)) FILTER (i = 1) AS project_path, 'm' || (arg_max(length(text), line_no) % 3) AS model FROM k GROUP BY file)
        SELECT b.file, coalesce(session_id, regexp_extract(b.file, '([^/]+)\\.jsonl$', 1)) AS session_id, project_path, model, strlen(content) AS size_bytes, 'read' AS state FROM bytes b LEFT JOIN meta m ON m.file = b.file WHERE NOT regexp_matches(b.file, '/subagents/')
        UNION ALL SELECT 'root/projects/s/' || s_suppkey || '.jsonl', s_suppkey || '.jsonl', NULL, NULL, 0, 'unreadable:scan-failed' FROM supplier""",
    "index_documents": f"""{_INDEX} SELECT CASE WHEN s_acctbal < 0 THEN 'deleted' WHEN s_suppkey % 7 = 0 THEN 'unreadable' ELSE 'session' END AS kind, account_uuid,
        CASE WHEN s_acctbal < 0 THEN s_suppkey::VARCHAR ELSE 'local_' || s_suppkey END AS desktop_session_id,
        CASE WHEN s_acctbal >= 0 AND s_suppkey % 7 > 0 AND s_suppkey % 4 > 0 THEN s_suppkey::VARCHAR END AS cli_session_id, CASE WHEN s_acctbal >= 0 AND s_suppkey % 7 > 0 THEN s_name END AS title,
        CASE WHEN s_acctbal >= 0 AND s_suppkey % 7 > 0 THEN '/w/' || s_nationkey END AS worktree_cwd, s_acctbal >= 0 AND s_suppkey % 7 > 0 AND s_suppkey % 2 = 0 AS is_archived,
        CASE WHEN s_acctbal < 0 OR s_suppkey % 7 > 0 THEN s_suppkey * 1000 END AS at_ms FROM placed""",
    "repaired_records": f"""{_INDEX} SELECT 'out/local_' || s_suppkey || '.json' AS file, '{{"cliSessionId":' || CASE WHEN s_suppkey % 4 > 0 THEN '"' || s_suppkey || '"' WHEN s_suppkey % 8 > 0 THEN '"found-' || s_suppkey || '"' ELSE 'null' END
        || ',"cwd":"/w/' || s_nationkey || '","isArchived":' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"lastActivityAt":' || s_suppkey * 1000 || ',"sessionId":"local_' || s_suppkey || '","title":' || to_json(s_name)
        || ',"zz":{{"kept":[1,null,' || to_json(s_name) || ']}}}}' AS record FROM placed WHERE s_acctbal >= 0 AND s_suppkey % 7 > 0""",
    "organisation_folders": f"{_INDEX} SELECT account_uuid, org AS organization_uuid, count(*) FILTER (s_acctbal >= 0) AS session_count, count(*) FILTER (s_acctbal < 0) AS deleted_count FROM placed GROUP BY 1, 2",
    "block_messages": r"""WITH b AS (SELECT conv_id, turn, role, text, turn % 6 AS k, to_json(text) AS q, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS side FROM conversations)
        SELECT 'c' || conv_id AS file_path, turn + 1 AS line_no, 0::BIGINT AS block_no, 'line-' || (turn + 1) AS message_id,
          CASE WHEN k IN (1, 2) THEN 'assistant' WHEN k = 3 THEN 'tool' ELSE side END AS role, CASE k WHEN 1 THEN 'thinking' WHEN 2 THEN 'tool_use' WHEN 3 THEN 'tool_result' ELSE 'text' END AS type,
          CASE WHEN k IN (0, 1) THEN text WHEN k = 3 THEN text || chr(10) || 'z' WHEN k = 4 THEN '[image]' END AS text,
          CASE k WHEN 2 THEN 'Read' WHEN 5 THEN 'new-kind' END AS tool_name,
          CASE k WHEN 2 THEN '{"a":' || q || ',"b":1}' WHEN 3 THEN '{"tool_use_id":"t1"}' END AS tool_input,
          CASE k WHEN 3 THEN '[{"text":' || q || ',"type":"text"},{"type":"image"},{"text":"z","type":"text"}]' WHEN 4 THEN '{"imageSource":"base64","mediaType":"image/png"}'
                 WHEN 5 THEN '{"type":"new-kind","v":' || q || '}' END AS tool_output FROM b
        UNION ALL SELECT 'c' || conv_id, turn + 1, 4, 'line-' || (turn + 1), 'tool', 'tool_result', NULL, NULL, NULL, '{"n":' || turn || '}' FROM b""",
    "account_list": f"""WITH {m.LISTING}, f AS (SELECT account_uuid, organization_uuid AS org, count(*) FILTER (kind = 'session') AS s, count(*) FILTER (kind = 'deleted') AS d,
          count(*) FILTER (kind = 'session' AND cli_session_id IS NOT NULL) AS c FROM index_entries GROUP BY 1, 2),
        a AS (SELECT account_uuid, count(*) AS n, min(org) AS org, sum(s)::BIGINT AS s, sum(d)::BIGINT AS d, sum(c)::BIGINT AS c FROM f GROUP BY 1),
        pairs AS (SELECT l.session_id, l.size_bytes, l.updated_at, l.n_accounts, c.account_uuid FROM listing l JOIN claims c ON c.cli_session_id = l.session_id
          UNION ALL SELECT session_id, size_bytes, updated_at, 1, owner_account FROM listing WHERE n_accounts = 0 AND owner_account IS NOT NULL),
        h AS (SELECT account_uuid, count(*) AS transcripts, count(*) FILTER (n_accounts = 1) AS exclusive, sum(size_bytes)::BIGINT AS bytes, max(updated_at) AS last_at FROM pairs GROUP BY 1),
        u AS (SELECT account_uuid FROM a UNION SELECT account_uuid FROM h)
        SELECT u.account_uuid, CASE WHEN r_regionkey = 3 THEN 'mine' WHEN r_regionkey < 3 THEN lower(r_name) || '@x' ELSE left(u.account_uuid, 8) END AS label,
          CASE WHEN r_regionkey = 3 THEN 'custom' WHEN r_regionkey = 1 THEN 'signed-in' WHEN r_regionkey < 3 THEN 'learned' ELSE 'uuid' END AS label_source, coalesce(r_regionkey = 1, false) AS is_current,
          CASE WHEN r_regionkey = 1 THEN 'main' WHEN n = 1 THEN org END AS history_org, CASE WHEN r_regionkey = 1 OR n = 1 THEN false ELSE true END AS ambiguous,
          CASE WHEN a.account_uuid IS NULL THEN 'no-folder' WHEN r_regionkey = 1 THEN 'signed-in' WHEN n = 1 THEN 'populated' ELSE 'several-populated' END AS reason,
          coalesce(s, 0) AS session_count, coalesce(d, 0) AS deleted_count, coalesce(c, 0) AS with_transcript, coalesce(transcripts, 0) AS transcripts, coalesce(exclusive, 0) AS exclusive,
          coalesce(bytes, 0) AS bytes, last_at, row_number() OVER (ORDER BY coalesce(r_regionkey = 1, false) DESC, coalesce(s, 0) DESC, u.account_uuid) AS place
        FROM u LEFT JOIN a ON a.account_uuid = u.account_uuid LEFT JOIN h ON h.account_uuid = u.account_uuid LEFT JOIN region ON r_name = a.account_uuid""",
    "migrated_sessions": """SELECT o_orderkey AS uid, o_orderpriority AS tool, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'AFRICA' WHEN '2-HIGH' THEN 'AMERICA' WHEN '3-MEDIUM' THEN 'ASIA' END, o_custkey::VARCHAR) AS account_id,
        CASE o_orderstatus WHEN 'F' THEN 'truncated' ELSE 'ok' END AS integrity FROM orders WHERE o_orderstatus <> 'P'""",
    "long_lines": """WITH d AS (SELECT lang, arg_max(struct_pack(i := doc_id, t := text), (n_chars, doc_id)) AS x FROM documents GROUP BY lang), r AS (SELECT lang, x.i AS doc_id, repeat(x.t, (20500000 // length(x.t) + 1)::BIGINT) AS t FROM d)
        SELECT 'l-' || lang AS file_path, 0::BIGINT AS pos, 'u' || doc_id AS row_uuid, 'text' AS type, length(t) AS n_chars, md5(t) AS text_md5 FROM r
        UNION ALL SELECT 'l-' || lang, 1, 'u' || doc_id, 'tool_use', NULL, NULL FROM r""",
}
