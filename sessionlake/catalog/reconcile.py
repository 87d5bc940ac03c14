"""Account sync and snapshot import: plans and what applying them does."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake import fixed_values as fv
from sessionlake.catalog import models as m
from sessionlake.operators import content
from sessionlake.plans import importing, store, sync
from sessionlake.session import shared


def _two_accounts(spark):
    return spark.createDataFrame([("/root/A", 0), ("/root/B", 1)], "root string, position int")


def _copy_plan(spark, sf):
    frame = m.copies(spark, sf)
    sessions = shared(m.copy_account_sessions(spark, sf, frame), "sessions")
    return sync.plan_sync(_two_accounts(spark), sessions, frame), sessions


def _document_plan(spark, sf):
    msgs, sessions = m.document_sessions(spark, sf)
    sessions = shared(sessions, "sessions")
    # Accounts in the order of their names.
    accounts = sessions.select("root").distinct().withColumn("position", F.col("root"))
    return sync.plan_sync(accounts, sessions, msgs), sessions


def sync_plan(spark, sf):
    """Two accounts holding copies of the conversations."""
    return _copy_plan(spark, sf)[0].select(
        "kind", "content_hash", "session_id", "source_uid", "source_path", "dest_root", "dest_path", "existing_uid",
        "relation", "common_prefix", "recommendation", "newer")


def sync_plan_documents(spark, sf):
    """D4 at volume: every source lacks most contents of the others."""
    return _document_plan(spark, sf)[0].select("kind", "content_hash", "session_id", "source_uid", "dest_root", "dest_path", "existing_uid", "relation")


def sync_plan_summary(spark, sf):
    """Actions and targets per kind, and how many contents there are."""
    plan = _document_plan(spark, sf)[0]
    return store.summarize_plan(plan, "dest_root")


def _resolutions(sessions):
    names = F.array(*[F.lit(x) for x in ("skip", "keep-existing", "keep-incoming", "keep-newer", "keep-both")])
    # The choice follows the size of the session; six messages: no choice made.
    return sessions.select(
        "session_id", F.col("root").alias("dest_root"),
        F.try_element_at(names, (F.col("message_count") % 6 + 1).cast("int")).alias("resolution")).where("resolution is not null")


def sync_outcomes(spark, sf):
    """What each action does under explicit choices."""
    plan, sessions = _copy_plan(spark, sf)
    paths = sessions.select(F.concat_ws("/", "root", "rel_path").alias("file_path"))
    done = sync.decide(plan, _resolutions(sessions), paths)
    return done.select("kind", "session_id", "dest_root", "applied", "write_path", "overwrites")


def sync_file_totals(spark, sf):
    """Messages per file after the sync, and rows backed up."""
    plan, sessions = _copy_plan(spark, sf)
    paths = sessions.select("uid", F.concat_ws("/", "root", "rel_path").alias("file_path"))
    done = sync.decide(plan, _resolutions(sessions), paths.select("file_path"))
    files = m.copies(spark, sf).select("uid", "pos", "text").join(paths, "uid").drop("uid")
    after, backups = sync.apply_to_files(done, files)
    count = lambda f, part: f.groupBy("file_path").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")).withColumn("part", F.lit(part))
    return count(after, "after").unionByName(count(backups, "backup"))


def sync_audit(spark, sf):
    """Audit events of an applied sync, per outcome."""
    plan, sessions = _copy_plan(spark, sf)
    paths = sessions.select(F.concat_ws("/", "root", "rel_path").alias("file_path"))
    done = sync.decide(plan, _resolutions(sessions), paths)
    events = store.audit_rows(done, "sync", F.lit(0).cast("timestamp"))
    return events.groupBy("action", "outcome").agg(F.count("*").alias("n_events"), F.count("error").alias("n_errors"))


def missing_contents(spark, sf):
    """Contents each source lacks."""
    plan = _document_plan(spark, sf)[0]
    return plan.where("dest_root is not null").groupBy("dest_root").agg(F.count("*").alias("n_missing"))


def contents_held_everywhere(spark, sf):
    """U4: conversations both accounts hold with the same content."""
    return _copy_plan(spark, sf)[0].where(F.col("kind") == fv.ALREADY_EVERYWHERE).select("session_id", "content_hash")


def content_copies(spark, sf):
    """Holders of every document content."""
    sessions = m.document_sessions(spark, sf)[1]
    return content.copies(sessions, "uid", "root")


def account_selection(spark, sf):
    """of the requested sources, which take part, which do not exist."""
    available = m.table(spark, sf, "documents").groupBy(F.col("source").alias("root")).agg(F.count("*").alias("n_sessions"))
    chosen, unmatched, excluded = sync.select_accounts(available, ["SRC1", "src2/", "src99"])
    tag = lambda f, t: f.select("root", F.lit(t).alias("part"))
    return tag(chosen, "chosen").unionByName(tag(unmatched, "unmatched")).unionByName(tag(excluded, "excluded"))


def _import(spark, sf):
    """Copy B as a snapshot, copy A as what is on disk."""
    frame = m.copies(spark, sf)
    sessions = shared(m.copy_account_sessions(spark, sf, frame), "sessions")
    digest = lambda path: F.sha2(F.concat_ws("|", "content_hash", path), 256)
    conv = F.col("session_id").cast("long")
    b = sessions.where("root = '/root/B'")
    records = b.select(
        conv.alias("manifest_index"), F.col("uid").alias("snapshot_uid"), "session_id",
        F.when(F.col("message_count") == 7, "other").otherwise("t").alias("tool"),
        F.concat(F.lit("/work/"), "session_id").alias("project_path"), "title",
        F.when(F.col("message_count") == 3, F.lit("../out.jsonl")).when(F.col("message_count") == 2, F.concat(F.lit("projects\\x\\n-"), "session_id", F.lit(".jsonl")))
        .otherwise(F.col("rel_path")).alias("original_relative"),
        "content_hash", "message_count", F.sha2("content_hash", 256).alias("raw_digest"), F.col("size_bytes").alias("raw_size"),
        "integrity", "updated_at")
    there = sessions.where("root = '/root/A'").select(
        "uid", F.lit("t").alias("dest_tool"), "session_id", F.concat_ws("/", "root", "rel_path").alias("file_path"),
        "size_bytes", "content_hash", "message_count", "updated_at")
    # Files of four messages are byte-identical copies when their content is the same.
    files = there.select("file_path", F.when(F.col("message_count") == 4, F.sha2("content_hash", 256)).otherwise("?").alias("raw_digest"))
    roots = spark.createDataFrame([("t", "/root/A")], "dest_tool string, root string")
    return records, importing.plan_import(records, roots, there, frame, files), files


def import_plan(spark, sf):
    """A snapshot against what is there."""
    return _import(spark, sf)[1].select(
        "manifest_index", "kind", "rule", "dest_path", "note", "existing_path", "relation", "recommendation")


def import_outcomes(spark, sf):
    """Outcomes by manifest position."""
    records, plan, files = _import(spark, sf)
    choices = records.select("manifest_index", F.when(F.col("message_count") % 2 == 0, "keep-both").otherwise("keep-newer").alias("resolution"))
    done = importing.decide(plan, records, choices, files.select("file_path"), F.lit("2026-01-02"))
    return done.select("manifest_index", "kind", "applied", "write_path", "overwrites")


QUERIES = {f.__name__: f for f in (
    sync_plan, sync_plan_documents, sync_plan_summary, sync_outcomes, sync_file_totals, sync_audit, missing_contents,
    contents_held_everywhere, content_copies, account_selection, import_plan, import_outcomes)}

# The plan over a view ``sessions`` (with position); conflicts keep their pair.
_PLAN = """
 loaded AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY position, updated_at DESC, uid) AS k,
            row_number() OVER (PARTITION BY root, session_id ORDER BY updated_at DESC, uid) AS j FROM sessions WHERE integrity NOT IN ('damaged', 'unreadable')),
 accounts AS (SELECT DISTINCT root FROM sessions),
 lacking AS (SELECT l.*, a.root AS dest_root FROM loaded l, accounts a WHERE l.k = 1 AND NOT EXISTS (
             SELECT 1 FROM loaded h WHERE h.content_hash = l.content_hash AND h.root = a.root)),
 plan AS (
  SELECT CASE WHEN e.uid IS NULL THEN 'copy' ELSE 'conflict' END AS kind, l.content_hash, l.session_id, l.uid AS source_uid,
         l.root || '/' || l.rel_path AS source_path, l.dest_root, l.dest_root || '/' || coalesce(e.rel_path, l.rel_path) AS dest_path, e.uid AS existing_uid, l.root AS source_root
  FROM lacking l LEFT JOIN loaded e ON e.root = l.dest_root AND e.session_id = l.session_id AND e.j = 1
  UNION ALL
  SELECT 'already-everywhere', content_hash, session_id, NULL, NULL, NULL, NULL, NULL, NULL FROM loaded l WHERE k = 1 AND
         (SELECT count(DISTINCT root) FROM loaded h WHERE h.content_hash = l.content_hash) = (SELECT count(*) FROM accounts)
  UNION ALL
  SELECT 'blocked', NULL, session_id, uid, root || '/' || rel_path, NULL, NULL, NULL, root FROM sessions WHERE integrity IN ('damaged', 'unreadable'))"""
# In a conflict the existing session is side a: for copy A it is the pair as
# compared, for copy B the sides are swapped.
_CONFLICTS = """
 judged AS (SELECT p.*, r.relation, CASE WHEN p.kind = 'conflict' THEN r.common_prefix END AS common_prefix,
   CASE WHEN p.kind <> 'conflict' THEN NULL WHEN p.existing_uid LIKE 'A-%' THEN r.a_length ELSE r.b_length END AS na,
   CASE WHEN p.kind <> 'conflict' THEN NULL WHEN p.existing_uid LIKE 'A-%' THEN r.b_length ELSE r.a_length END AS nb, e.updated_at AS ea, s.updated_at AS sa
   FROM plan p LEFT JOIN compared r ON p.kind = 'conflict' AND r.pair_id::VARCHAR = p.session_id
   LEFT JOIN sessions e ON e.uid = p.existing_uid LEFT JOIN sessions s ON s.uid = p.source_uid)"""
_COPIES = (f"WITH {m.COPIES}, {m.COPY_SESSIONS}, {m.COPY_TIMES}, {m.COPY_COMPARED}, {m.COPY_ACCOUNT_SESSIONS}, {_PLAN}, {_CONFLICTS}")
_DOCS = f"WITH {m.DOCUMENT_SESSIONS}, {_PLAN}"
_NEWER = "CASE WHEN kind = 'conflict' THEN CASE WHEN ea > sa THEN 'a' WHEN sa > ea THEN 'b' END END"
_OUTCOMES = f"""
 chosen AS (SELECT j.*, {_NEWER} AS newer, ['skip', 'keep-existing', 'keep-incoming', 'keep-newer', 'keep-both'][(d.message_count % 6 + 1)::INT] AS choice
   FROM judged j LEFT JOIN sessions d ON d.session_id = j.session_id AND d.root = j.dest_root),
 intended AS (SELECT *, CASE kind WHEN 'already-everywhere' THEN 'no-op' WHEN 'blocked' THEN 'blocked' WHEN 'copy' THEN 'copied' ELSE
   CASE WHEN choice IS NULL OR choice = 'skip' THEN 'skipped-unresolved' WHEN choice = 'keep-existing' THEN 'kept-existing'
        WHEN choice = 'keep-incoming' THEN 'overwritten' WHEN choice = 'keep-newer' AND newer = 'b' THEN 'overwritten-newer'
        WHEN choice = 'keep-newer' THEN 'kept-existing-newer' ELSE 'written-alongside' END END AS intent FROM chosen),
 pathed AS (SELECT *, CASE WHEN intent IN ('copied', 'overwritten', 'overwritten-newer') THEN dest_path
   WHEN intent = 'written-alongside' THEN left(dest_path, length(dest_path) - 6) || '--from-' || right(source_root, 1) || '.jsonl' END AS p,
   dest_path IN (SELECT root || '/' || rel_path FROM sessions) AND intent <> 'written-alongside' AS there FROM intended),
 outcomes AS (SELECT *, CASE WHEN p IS NOT NULL AND there AND intent = 'copied' THEN 'failed' ELSE intent END AS applied,
   CASE WHEN p IS NOT NULL AND there AND intent = 'copied' THEN NULL ELSE p END AS write_path,
   p IS NOT NULL AND there AND intent <> 'copied' AS overwrites FROM pathed)"""
_IMPORT = """
 rec AS (SELECT session_id::BIGINT AS manifest_index, uid, session_id, message_count, content_hash, integrity, updated_at, size_bytes,
   CASE WHEN message_count = 7 THEN NULL ELSE '/root/A' END AS droot,
   CASE WHEN message_count = 3 THEN '/root/A/projects/-work-' || session_id || '/' || session_id || '.jsonl'
        WHEN message_count = 2 THEN '/root/A/projects/x/n-' || session_id || '.jsonl' ELSE '/root/A/' || rel_path END AS place FROM sessions WHERE root = '/root/B'),
 dst AS (SELECT *, root || '/' || rel_path AS file_path FROM sessions WHERE root = '/root/A'),
 ruled AS (SELECT rec.*, CASE WHEN droot IS NOT NULL THEN place END AS dest_path, CASE WHEN message_count = 3 THEN 'recorded location ignored: outside the root' END AS note,
   (SELECT min(file_path) FROM dst WHERE dst.content_hash = rec.content_hash) AS hash_path,
   (SELECT file_path FROM dst WHERE dst.file_path = rec.place) AS at_path,
   (SELECT file_path FROM dst WHERE dst.session_id = rec.session_id) AS id_path,
   (SELECT message_count FROM dst WHERE dst.file_path = rec.place) AS at_n FROM rec),
 rules AS (SELECT *, CASE WHEN integrity = 'damaged' THEN 'source-damaged' WHEN droot IS NULL THEN 'no-root'
   WHEN at_n = 4 AND hash_path = place THEN 'same-bytes' WHEN hash_path IS NOT NULL THEN 'same-content'
   WHEN coalesce(at_path, id_path) IS NOT NULL THEN 'differs' ELSE 'absent' END AS rule FROM ruled),
 import_plan AS (SELECT manifest_index, rules.session_id, rules.message_count, CASE rule WHEN 'source-damaged' THEN 'blocked' WHEN 'no-root' THEN 'blocked' WHEN 'same-bytes' THEN 'skip-identical'
   WHEN 'same-content' THEN 'skip-identical' WHEN 'differs' THEN 'conflict' ELSE 'write' END AS kind, rule, dest_path,
   CASE WHEN droot IS NOT NULL THEN note END AS note,
   CASE WHEN rule IN ('same-bytes', 'same-content') THEN hash_path WHEN rule = 'differs' THEN coalesce(at_path, id_path) END AS existing_path,
   CASE WHEN rule = 'differs' THEN r.relation END AS relation,
   CASE WHEN rule = 'differs' THEN CASE r.relation WHEN 'prefix' THEN CASE WHEN b_length > a_length THEN 'keep-incoming' ELSE 'keep-existing' END ELSE 'keep-both' END END AS recommendation,
   a.updated_at AS ea, rules.updated_at AS sa
   FROM rules LEFT JOIN compared r ON r.pair_id = manifest_index LEFT JOIN dst a ON a.session_id = rules.session_id)"""

SQL = {
    "sync_plan": f"""{_COPIES} SELECT kind, content_hash, session_id, source_uid, source_path, dest_root, dest_path, existing_uid, relation, common_prefix,
        CASE WHEN kind = 'conflict' THEN CASE relation WHEN 'prefix' THEN CASE WHEN nb > na THEN 'keep-incoming' ELSE 'keep-existing' END ELSE 'keep-both' END END AS recommendation,
        {_NEWER} AS newer FROM judged""",
    "sync_plan_documents": f"{_DOCS} SELECT kind, content_hash, session_id, source_uid, dest_root, dest_path, existing_uid, CASE WHEN kind = 'conflict' THEN 'unrelated' END AS relation FROM plan",
    "sync_plan_summary": f"{_DOCS} SELECT kind, count(*) AS n_actions, count(DISTINCT dest_root) AS n_targets FROM plan GROUP BY 1",
    "sync_outcomes": f"{_COPIES}, {_OUTCOMES} SELECT kind, session_id, dest_root, applied, write_path, overwrites FROM outcomes",
    "sync_file_totals": f"""{_COPIES}, {_OUTCOMES}, files AS (SELECT s.root || '/' || s.rel_path AS file_path, text FROM copies JOIN sessions s USING (uid)),
        gone AS (SELECT DISTINCT write_path FROM outcomes WHERE overwrites)
        SELECT 'after' AS part, file_path, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM (
          SELECT file_path, text FROM files WHERE file_path NOT IN (SELECT write_path FROM gone)
          UNION ALL SELECT o.write_path, f.text FROM outcomes o JOIN files f ON f.file_path = o.source_path WHERE o.write_path IS NOT NULL) GROUP BY file_path
        UNION ALL SELECT 'backup', file_path, count(*), sum(length(text))::BIGINT FROM files WHERE file_path IN (SELECT write_path FROM gone) GROUP BY file_path""",
    "sync_audit": f"""{_COPIES}, {_OUTCOMES} SELECT 'sync' AS action, applied AS outcome, count(*) AS n_events, count(*) FILTER (applied = 'failed') AS n_errors FROM outcomes GROUP BY applied""",
    "missing_contents": f"{_DOCS} SELECT dest_root, count(*) AS n_missing FROM plan WHERE dest_root IS NOT NULL GROUP BY 1",
    "contents_held_everywhere": f"{_COPIES} SELECT session_id, content_hash FROM plan WHERE kind = 'already-everywhere'",
    "content_copies": f"WITH {m.DOCUMENT_SESSIONS} SELECT content_hash, count(*) AS copies, count(DISTINCT root) AS holders, min(uid) AS first_item FROM sessions GROUP BY 1",
    "account_selection": """SELECT DISTINCT source AS root, CASE WHEN source IN ('src1', 'src2') THEN 'chosen' ELSE 'excluded' END AS part FROM documents
        UNION ALL SELECT 'src99', 'unmatched'""",
    "import_plan": f"{_COPIES}, {_IMPORT} SELECT manifest_index, kind, rule, dest_path, note, existing_path, relation, recommendation FROM import_plan",
    "import_outcomes": f"""{_COPIES}, {_IMPORT} SELECT manifest_index, kind, applied, CASE WHEN applied = 'written-alongside' THEN left(dest_path, length(dest_path) - 6) || '--imported-2026-01-02.jsonl'
          WHEN applied IN ('written', 'overwritten-newer') THEN dest_path END AS write_path, applied = 'overwritten-newer' AND dest_path IN (SELECT file_path FROM dst) AS overwrites FROM (
        SELECT *, CASE kind WHEN 'blocked' THEN 'blocked' WHEN 'skip-identical' THEN 'skipped-identical' WHEN 'write' THEN 'written' ELSE
          CASE WHEN message_count % 2 = 0 THEN 'written-alongside' WHEN sa > ea THEN 'overwritten-newer' ELSE 'kept-existing-newer' END END AS applied FROM import_plan)""",
}
