"""The supplied tables seen as transcripts, copies, indexes and accounts.

Every frame here has a SQL text of the same name (upper case) that derives the
same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.functions import hashing
from sessionlake.functions.jsonvalues import quoted
from sessionlake.session import configure, shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- normalisation and digests, in SQL -------------------------------------

def sql_norm(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), "
        f"'(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    )


def sql_message_json(role: str, text: str, type_: str = "'text'") -> str:
    return (
        f"'{{\"role\":' || to_json({role}) || ',\"text\":' || to_json({sql_norm(text)}) || "
        f"',\"toolInput\":null,\"toolName\":null,\"toolOutput\":null,\"type\":' || to_json({type_}) || '}}'"
    )


def sql_content_hash(source: str, keys: str, pos: str = "pos", digest: str = "msg_digest") -> str:
    """Statement computing the tree digest of ``source`` per ``keys``."""
    return (
        f"SELECT {keys}, 'sha256:' || sha256('session-v1' || chr(10) || string_agg(d, '' ORDER BY run)) AS content_hash, "
        f"sum(n)::BIGINT AS message_count FROM (SELECT {keys}, {pos} // 4096 AS run, "
        f"sha256(string_agg({digest}, '' ORDER BY {pos})) AS d, count(*) AS n FROM {source} "
        f"GROUP BY {keys}, {pos} // 4096) GROUP BY {keys}"
    )


# --- conversations as normalised sessions -----------------------------------

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: uid, pos, role, type, text and the message digest."""
    null = F.lit(None).cast("string")
    frame = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("uid"), F.col("turn").alias("pos"), "role", F.lit("text").alias("type"), "text",
        null.alias("tool_name"), null.alias("tool_input"), null.alias("tool_output"),
    )
    return frame.withColumn("msg_digest", hashing.message_digest())


MESSAGES = (
    "messages AS (SELECT conv_id AS uid, turn AS pos, role, 'text' AS type, text, "
    f"sha256({sql_message_json('role', 'text')}) AS msg_digest FROM conversations)"
)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two copies of every conversation.

    Copy B was kept by another account: it lacks a last turn nobody answered,
    and a letter was redacted in it.
    """
    t = table(spark, sf_dir, "conversations")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    null = F.lit(None).cast("string")
    a = t.select("conv_id", "turn", "role", "text", F.lit("A").alias("account"))
    b = (
        t.join(last, "conv_id")
        .where(~((F.col("role") == "user") & (F.col("turn") == F.col("last_turn"))))
        .select("conv_id", "turn", "role", F.replace("text", F.lit("k"), F.lit("#")).alias("text"), F.lit("B").alias("account"))
    )
    frame = a.unionByName(b).select(
        F.concat("account", F.lit("-"), "conv_id").alias("uid"), "account", "conv_id",
        F.col("turn").alias("pos"), "role", F.lit("text").alias("type"), "text",
        null.alias("tool_name"), null.alias("tool_input"), null.alias("tool_output"),
    )
    return shared(frame.withColumn("msg_digest", hashing.message_digest()), "copies")


COPIES = (
    "sided AS (SELECT conv_id, turn, role, text, 'A' AS account FROM conversations UNION ALL "
    "SELECT conv_id, turn, role, replace(text, 'k', '#'), 'B' FROM (SELECT *, max(turn) OVER "
    "(PARTITION BY conv_id) AS last_turn FROM conversations) WHERE NOT (role = 'user' AND turn = last_turn)), "
    "copies AS (SELECT account || '-' || conv_id AS uid, account, conv_id, turn AS pos, role, 'text' AS type, text, "
    f"sha256({sql_message_json('role', 'text')}) AS msg_digest FROM sided)"
)

COPY_SESSIONS = (
    f"copy_sessions AS (SELECT h.*, c.account, c.conv_id FROM ({sql_content_hash('copies', 'uid')}) h JOIN "
    "(SELECT DISTINCT uid, account, conv_id FROM copies) c USING (uid))"
)


# Time of a copy: the longer the conversation, the later it was touched; copy B
# is touched a second later when it is of odd id.
def copy_sessions(frame: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Session facts of the copies, from the lower level of their digest trees where that is there."""
    from sessionlake.operators import content

    keys = ["uid", "account", "conv_id"]
    hashed = content.content_hash(frame, keys) if runs is None else content.hash_of_runs(runs, keys)
    seconds = F.col("conv_id") * 60 + F.when(F.col("account") == "B", F.col("message_count") - 4).otherwise(0)
    return shared(hashed.withColumn("updated_at", F.timestamp_seconds(F.lit(1_700_000_000) + seconds)), "copy-sessions")


COPY_TIMES = (
    "timed AS (SELECT *, make_timestamp((1700000000 + conv_id * 60 + CASE WHEN account = 'B' "
    "THEN message_count - 4 ELSE 0 END) * 1000000) AS updated_at FROM copy_sessions)"
)


def copy_pairs(frame: DataFrame) -> DataFrame:
    """One pair per conversation; copy B may have lost all its turns."""
    return frame.select("conv_id").distinct().select(
        F.col("conv_id").alias("pair_id"),
        F.concat(F.lit("A-"), "conv_id").alias("a_uid"), F.concat(F.lit("B-"), "conv_id").alias("b_uid"),
    )


# Relation of both copies, by a walk over positions.
COPY_COMPARED = (
    "walk AS (SELECT coalesce(a.conv_id, b.conv_id) AS pair_id, count(a.pos) AS a_length, count(b.pos) AS b_length, "
    "min(coalesce(a.pos, b.pos)) FILTER (WHERE a.msg_digest IS DISTINCT FROM b.msg_digest) AS f "
    "FROM (SELECT * FROM copies WHERE account = 'A') a FULL JOIN (SELECT * FROM copies WHERE account = 'B') b "
    "ON a.conv_id = b.conv_id AND a.pos = b.pos GROUP BY 1), "
    "compared AS (SELECT pair_id, a_length, b_length, coalesce(f, a_length) AS common_prefix, "
    "CASE WHEN a_length = 0 OR b_length = 0 THEN 'empty' WHEN f IS NULL THEN 'identical' "
    "WHEN f = a_length OR f = b_length THEN 'prefix' WHEN f = 0 THEN 'unrelated' ELSE 'diverged' END AS relation FROM walk)"
)


# --- conversations as transcript files --------------------------------------

def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of one transcript per conversation, some of them damaged.

    A line whose text holds a k was cut while being copied; a last user turn
    was still being written.  System turns are rows of another type.
    """
    t = table(spark, sf_dir, "conversations")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    joined = t.join(last, "conv_id")
    whole = F.concat(
        F.lit('{"type":"'), F.col("role"), F.lit('","uuid":"u'), F.col("conv_id"), F.lit("-"), F.col("turn"),
        F.lit('","sessionId":"'), F.col("conv_id"), F.lit('","cwd":"/work/'), F.substring("text", 1, 2),
        F.lit('","message":{"role":"'), F.col("role"), F.lit('","model":"m'), F.length("text") % 3,
        F.lit('","content":[{"type":"text","text":'), quoted(F.col("text")), F.lit("}]}}"),
    )
    tail = (F.col("turn") == F.col("last_turn")) & (F.col("role") == "user")
    cut = F.contains("text", F.lit("k")) | tail
    raw = F.when(cut, F.substring(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole)
    return joined.select(
        F.concat(F.lit("/p/"), "conv_id", F.lit(".jsonl")).alias("file_path"),
        (F.col("turn") + 1).alias("line_no"), (F.col("last_turn") + 1).alias("total_lines"),
        F.lit(False).alias("last_line_terminated"), raw.alias("raw"), "conv_id",
    )


TRANSCRIPT_LINES = (
    "whole AS (SELECT conv_id, turn, role, text, last_turn, (turn = last_turn AND role = 'user') AS tail, "
    "'{\"type\":\"' || role || '\",\"uuid\":\"u' || conv_id || '-' || turn || '\",\"sessionId\":\"' || conv_id || "
    "'\",\"cwd\":\"/work/' || left(text, 2) || '\",\"message\":{\"role\":\"' || role || '\",\"model\":\"m' || (length(text) % 3) || "
    "'\",\"content\":[{\"type\":\"text\",\"text\":' || to_json(text) || '}]}}' AS whole "
    "FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)), "
    "lines AS (SELECT '/p/' || conv_id || '.jsonl' AS file_path, turn + 1 AS line_no, last_turn + 1 AS total_lines, conv_id, turn, role, text, "
    "CASE WHEN contains(text, 'k') OR tail THEN left(whole, length(whole) - 5) ELSE whole END AS raw FROM whole), "
    "gated AS (SELECT *, CASE WHEN json_valid(raw) THEN 'ok' WHEN line_no = total_lines THEN 'truncated-tail' ELSE 'parse' END AS status FROM lines)"
)


# --- documents as files of lines, and as sessions of one message -------------

def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines of the documents, split on line feeds only."""
    return (
        table(spark, sf_dir, "documents")
        .select(F.concat(F.lit("doc_"), "doc_id").alias("file_path"), "doc_id",
                F.posexplode(F.split("text", "\n")).alias("p", "raw"))
        .select("file_path", "doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "raw")
    )


DOCUMENT_LINES = (
    "doc_lines AS (SELECT 'doc_' || doc_id AS file_path, doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS raw "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
)


# --- sessions of accounts ----------------------------------------------------

def copy_account_sessions(spark: SparkSession, sf_dir: str, frame: DataFrame) -> DataFrame:
    """Both copies as sessions of two account folders; a conversation with a
    system turn is damaged in the folder of copy B."""
    system = frame.groupBy("uid").agg(F.bool_or(F.col("role") == "system").alias("has_system"))
    return copy_sessions(frame).join(system, "uid").select(
        "uid", F.concat(F.lit("/root/"), "account").alias("root"), F.col("conv_id").cast("string").alias("session_id"),
        "content_hash", "message_count", "updated_at",
        F.when(F.col("has_system") & (F.col("account") == "B"), "damaged").otherwise("ok").alias("integrity"),
        F.concat(F.lit("projects/x/"), "conv_id", F.lit(".jsonl")).alias("rel_path"),
        F.concat(F.lit("conversation "), "conv_id").alias("title"), (F.col("message_count") * 100).alias("size_bytes"),
    )


COPY_ACCOUNT_SESSIONS = (
    "sessions AS (SELECT t.uid, '/root/' || t.account AS root, CASE WHEN t.account = 'A' THEN 0 ELSE 1 END AS position, "
    "t.conv_id::VARCHAR AS session_id, content_hash, message_count, updated_at, "
    "CASE WHEN s.has_system AND t.account = 'B' THEN 'damaged' ELSE 'ok' END AS integrity, "
    "'projects/x/' || t.conv_id || '.jsonl' AS rel_path, 'conversation ' || t.conv_id AS title, message_count * 100 AS size_bytes "
    "FROM timed t JOIN (SELECT uid, bool_or(role = 'system') AS has_system FROM copies GROUP BY uid) s USING (uid))"
)


def document_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as one-message sessions: the source is the account folder and
    the length is the session id.  Returns messages and sessions."""
    from sessionlake.operators import content

    docs = table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    msgs = content.with_digest(docs.select(
        F.col("doc_id").alias("uid"), F.lit(0).cast("long").alias("pos"), F.lit("user").alias("role"),
        F.lit("text").alias("type"), "text", null.alias("tool_name"), null.alias("tool_input"), null.alias("tool_output"),
    ))
    hashed = content.content_hash(msgs, ["uid"])
    sessions = docs.withColumnRenamed("doc_id", "uid").join(hashed, "uid").select(
        "uid", F.col("source").alias("root"), F.col("n_chars").cast("string").alias("session_id"), "content_hash",
        "message_count", F.lit("ok").alias("integrity"), F.timestamp_seconds("n_chars").alias("updated_at"),
        F.concat(F.lit("projects/"), "lang", F.lit("/"), "n_chars", F.lit(".jsonl")).alias("rel_path"),
        F.col("lang").alias("title"), F.col("n_chars").alias("size_bytes"),
    )
    return msgs, sessions


DOCUMENT_SESSIONS = (
    "doc_messages AS (SELECT doc_id AS uid, 0 AS pos, "
    f"sha256({sql_message_json(chr(39) + 'user' + chr(39), 'text')}) AS msg_digest FROM documents), "
    "sessions AS (SELECT doc_id AS uid, source AS root, row_number AS position, n_chars::VARCHAR AS session_id, "
    "'sha256:' || sha256('session-v1' || chr(10) || sha256(msg_digest)) AS content_hash, 1 AS message_count, 'ok' AS integrity, "
    "make_timestamp(n_chars * 1000000) AS updated_at, 'projects/' || lang || '/' || n_chars || '.jsonl' AS rel_path, "
    "lang AS title, n_chars AS size_bytes FROM documents d JOIN doc_messages m ON m.uid = d.doc_id "
    "JOIN (SELECT source, row_number() OVER (ORDER BY source) AS row_number FROM (SELECT DISTINCT source FROM documents)) USING (source))"
)


# --- line items as index records of five accounts -----------------------------

def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries: the account is the supplier's region, the record id the
    part, the transcript the order.  The last shipment of a part is its record;
    untaxed ones lost their transcript id; returned parts were deleted."""
    place = (
        table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("account_uuid"))
    )
    items = table(spark, sf_dir, "lineitem").join(place, "l_suppkey")
    last = items.where("l_returnflag = 'N'").groupBy("account_uuid", "l_partkey").agg(
        F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_tax", "l_linestatus", "l_extendedprice")).alias("x"))
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    org = F.when(F.col("x.l_linenumber") < 6, "main").otherwise("other")
    cwd = F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand")
    null = F.lit(None).cast("string")
    sessions = last.join(part, "l_partkey").select(
        F.lit("session").alias("kind"), "account_uuid", org.alias("organization_uuid"),
        F.concat(F.lit("local_"), "l_partkey").alias("desktop_session_id"),
        F.when(F.col("x.l_tax") > 0, F.col("x.l_orderkey").cast("string")).alias("cli_session_id"), F.col("p_name").alias("title"),
        cwd.alias("project_path"), cwd.alias("worktree_cwd"), null.alias("origin_cwd"), null.alias("branch"),
        (F.col("x.l_linestatus") == "F").alias("is_archived"), F.col("x.l_shipdate").alias("last_activity_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.concat(F.lit("/idx/"), "account_uuid", F.lit("/"), org, F.lit("/local_"), "l_partkey", F.lit(".json")).alias("index_path"),
    )
    deleted = items.where("l_returnflag = 'R'").groupBy("account_uuid", "l_partkey").agg(F.max("l_shipdate").alias("deleted_at")).select(
        F.lit("deleted").alias("kind"), "account_uuid", F.lit("main").alias("organization_uuid"),
        F.col("l_partkey").cast("string").alias("desktop_session_id"), F.lit(False).alias("is_archived"), "deleted_at",
        F.concat(F.lit("/idx/"), "account_uuid", F.lit("/main/deleted_"), "l_partkey").alias("index_path"),
    )
    return shared(sessions.unionByName(deleted, True), "index-entries")


INDEX_ENTRIES = (
    "items AS (SELECT l.*, r_name AS account_uuid FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey "
    "JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey), "
    "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_uuid, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, "
    "l_linenumber DESC, l_tax DESC, l_linestatus DESC, l_extendedprice DESC) AS k FROM items WHERE l_returnflag = 'N') WHERE k = 1), "
    "index_entries AS (SELECT 'session' AS kind, account_uuid, CASE WHEN l_linenumber < 6 THEN 'main' ELSE 'other' END AS organization_uuid, "
    "'local_' || l_partkey AS desktop_session_id, CASE WHEN l_tax > 0 THEN l_orderkey::VARCHAR END AS cli_session_id, p_name AS title, "
    "'/' || p_type || '/' || p_brand AS project_path, l_linestatus = 'F' AS is_archived, l_shipdate AS last_activity_at, NULL::TIMESTAMP AS deleted_at, "
    "'/idx/' || account_uuid || '/' || CASE WHEN l_linenumber < 6 THEN 'main' ELSE 'other' END || '/local_' || l_partkey || '.json' AS index_path "
    "FROM last JOIN part ON p_partkey = l_partkey UNION ALL "
    "SELECT 'deleted', account_uuid, 'main', l_partkey::VARCHAR, NULL, NULL, NULL, false, NULL, max(l_shipdate), "
    "'/idx/' || account_uuid || '/main/deleted_' || l_partkey FROM items WHERE l_returnflag = 'R' GROUP BY account_uuid, l_partkey), "
    "records AS (SELECT * FROM index_entries WHERE kind = 'session' AND organization_uuid = 'main' AND account_uuid <> 'MIDDLE EAST'), "
    "tombstones AS (SELECT account_uuid, desktop_session_id AS bare FROM index_entries WHERE kind = 'deleted' AND account_uuid <> 'MIDDLE EAST'), "
    "accounts AS (SELECT r_name AS account_uuid, r_regionkey AS position FROM region WHERE r_name <> 'MIDDLE EAST'), "
    "listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_uuid, cli_session_id ORDER BY index_path DESC) AS j "
    "FROM records WHERE cli_session_id IS NOT NULL) WHERE j = 1)"
)


def index_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as accounts; for one of them the folder is not known."""
    unknown = F.col("r_name") == "MIDDLE EAST"
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("account_uuid"), F.col("r_regionkey").alias("position"), F.col("r_name").alias("label"),
        F.when(~unknown, "main").alias("history_org"), F.when(~unknown, F.concat(F.lit("/idx/"), "r_name", F.lit("/main"))).alias("history_dir"),
        unknown.alias("ambiguous"), F.when(unknown, "several-populated").otherwise("populated").alias("reason"),
    )


# --- orders as listed transcripts ----------------------------------------------

def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: orders are main transcripts, their line items sub-agents."""
    null = F.lit(None).cast("string")
    main = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/r/projects/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".jsonl")).alias("file_path"),
        F.lit("/r").alias("root"), F.col("o_custkey").cast("string").alias("project_dir"), F.col("o_orderkey").cast("string").alias("file_session_id"),
        F.lit("main").alias("kind"), null.alias("parent_session_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
        F.col("o_orderdate").alias("mtime"),
    )
    child = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/r/projects/x/"), "l_orderkey", F.lit("/subagents/workflows/"), "l_partkey", F.lit("/"), "l_suppkey", F.lit(".jsonl")).alias("file_path"),
        F.lit("/r").alias("root"), F.lit("x").alias("project_dir"), F.col("l_suppkey").cast("string").alias("file_session_id"),
        F.lit("agent").alias("kind"), F.col("l_orderkey").cast("string").alias("parent_session_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size_bytes"), F.col("l_shipdate").alias("mtime"),
    )
    return main.unionByName(child)


def order_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing records of the orders, as the scan of their files would give."""
    null = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.concat(F.lit("/r/projects/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".jsonl")).alias("file_path"), F.lit("/r").alias("root"),
        F.col("o_custkey").cast("string").alias("project_dir"), F.col("o_custkey").cast("string").alias("project_path_decoded"),
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("/seg/"), "c_mktsegment")).alias("project_path"),
        F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Order "), "o_orderkey")).alias("title"),
        null.alias("version"), null.alias("git_branch"), null.alias("created_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
        F.col("o_orderdate").alias("mtime"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("c_mktsegment")).alias("owner_account"), null.alias("owner_org"),
    )


def order_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "truncated").otherwise("damaged")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/r/projects/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".jsonl")).alias("file_path"), states.alias("integrity"))


LISTING = (
    f"{INDEX_ENTRIES}, "
    "claims AS (SELECT cli_session_id, account_uuid, count(*) AS records, min(index_path) AS first_path FROM index_entries WHERE kind = 'session' AND cli_session_id IS NOT NULL GROUP BY 1, 2), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cli_session_id ORDER BY last_activity_at DESC, index_path) AS k FROM index_entries "
    "WHERE kind = 'session' AND cli_session_id IS NOT NULL) WHERE k = 1), "
    "claimed AS (SELECT cli_session_id, count(*) AS n_accounts, sum(records)::BIGINT AS n_records, min(account_uuid) AS only_account FROM claims GROUP BY 1), "
    "children AS (SELECT l_orderkey::VARCHAR AS session_id, count(*) AS n FROM lineitem GROUP BY 1), "
    "listing AS (SELECT '/r/projects/' || o_custkey || '/' || o_orderkey || '.jsonl' AS file_path, '/r' AS root, o_orderkey::VARCHAR AS session_id, o_custkey::VARCHAR AS project_dir, "
    "CASE WHEN c_mktsegment <> 'BUILDING' THEN '/seg/' || c_mktsegment ELSE b.project_path END AS project_path, o_orderpriority AS model, "
    "coalesce(CASE WHEN o_orderstatus = 'F' THEN 'Order ' || o_orderkey END, b.title) AS title, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, "
    "round(o_totalprice * 100)::BIGINT AS size_bytes, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'truncated' ELSE 'damaged' END AS integrity, "
    "coalesce(ch.n, 0) AS sub_agent_count, CASE WHEN n_accounts = 1 THEN only_account WHEN o_orderpriority = '1-URGENT' THEN c_mktsegment END AS owner_account, "
    "CASE WHEN n_accounts = 1 THEN 'desktop-index' WHEN n_accounts > 1 AND o_orderpriority <> '1-URGENT' THEN 'shared' "
    "WHEN n_accounts IS NULL AND o_orderpriority = '1-URGENT' THEN 'transcript' END AS owner_source, coalesce(n_accounts, 0) AS n_accounts, "
    "b.desktop_session_id AS desktop_session_id, b.is_archived AS is_archived "
    "FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN claimed c ON c.cli_session_id = o_orderkey::VARCHAR "
    "LEFT JOIN best b ON b.cli_session_id = o_orderkey::VARCHAR LEFT JOIN children ch ON ch.session_id = o_orderkey::VARCHAR)"
)


def listing(spark: SparkSession, sf_dir: str):
    """Sessions with owners, and the claims behind them."""
    from sessionlake.operators import listing as ls

    claims = ls.index_claims(index_entries(spark, sf_dir))
    claims = shared(claims, "claims")
    sessions = ls.list_sessions(
        order_meta(spark, sf_dir), transcript_files(spark, sf_dir), claims, order_integrity(spark, sf_dir), "t", "acct")
    return sessions, claims
