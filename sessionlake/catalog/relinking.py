"""Broken records, orphans, and what transcripts say about themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.functions.paths import encode_project_dir
from sessionlake.operators import listing as ls
from sessionlake.plans import relink, store
from sessionlake.session import shared
from sessionlake.sources import jsonl


def _transcripts(spark, sf):
    """Orders as transcripts: the part numbered like the customer gives the
    titles (typed for orders on the way) and the folder."""
    o, p = m.table(spark, sf, "orders"), m.table(spark, sf, "part")
    cwd = F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand")
    frame = o.join(p, F.col("o_custkey") == F.col("p_partkey")).select(
        F.concat(F.lit("/t/"), "o_orderkey", F.lit(".jsonl")).alias("file_path"), F.col("o_orderkey").cast("string").alias("session_id"),
        encode_project_dir(cwd).alias("folder"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
        F.col("o_orderdate").cast("timestamp").alias("mtime"), F.when(F.col("o_orderstatus") != "P", F.col("p_name")).alias("custom_title"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("ai_title"), F.when(F.col("o_orderpriority") != "5-LOW", cwd).alias("cwd"),
        F.col("o_orderpriority").alias("model"), F.col("o_orderdate").cast("timestamp").alias("first_at"), F.lit(None).cast("timestamp").alias("last_at"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "damaged").otherwise("ok").alias("integrity"))
    frame = shared(frame, "order-transcripts")
    titles = frame.select("file_path", F.explode(F.array_compact(F.array("custom_title", "ai_title"))).alias("title"))
    return frame, titles


def _scan(spark, sf):
    transcripts, titles = _transcripts(spark, sf)
    return relink.scan_broken(m.index_entries(spark, sf), transcripts, titles)


def broken_records(spark, sf):
    """records without a transcript id."""
    return relink.broken_records(m.index_entries(spark, sf)).select("index_path", "account_uuid", "title", "missing_pointer", "missing_cwd")


def relink_scan(spark, sf):
    """The transcript each broken record gets."""
    return _scan(spark, sf).select("index_path", "account_uuid", "title", "best_session_id", "match", "in_folder", "n_matches", "confidence")


def relink_repairs(spark, sf):
    """Planned repairs by kind and confidence."""
    return relink.plan_repair(_scan(spark, sf)).groupBy("kind", "confidence").agg(F.count("*").alias("n_actions"))


def repaired_index(spark, sf):
    """Index records before and after the repair."""
    entries = m.index_entries(spark, sf).where("kind = 'session'")
    transcripts, titles = _transcripts(spark, sf)
    plan = shared(relink.plan_repair(relink.scan_broken(entries, transcripts, titles)), "repairs")
    after, outcomes, backup = relink.apply_repair(plan, entries, transcripts)
    tally = lambda f, part: f.agg(F.count("*").alias("n_rows"), F.count("cli_session_id").alias("n_pointers")).withColumn("part", F.lit(part))
    done = store.summarize_results(outcomes).select(F.col("n_actions").alias("n_rows"), F.lit(0).cast("long").alias("n_pointers"), F.col("applied").alias("part"))
    return tally(after, "after").unionByName(tally(backup, "backup")).unionByName(done)


def title_candidates(spark, sf):
    """The five best transcripts by title, folder, edit and size."""
    transcripts, titles = _transcripts(spark, sf)
    out = relink.title_candidates(m.index_entries(spark, sf), transcripts, titles)
    return out.select("index_path", F.col("place").cast("long").alias("place"), "session_id")


def title_ranks(spark, sf):
    """How each linked record's title answers its transcript's."""
    transcripts, _ = _transcripts(spark, sf)
    linked = m.index_entries(spark, sf).where("cli_session_id IS NOT NULL").select("index_path", F.col("cli_session_id").alias("session_id"), "title")
    return linked.join(transcripts, "session_id").select(
        "index_path", relink.title_match(F.col("title"), F.col("custom_title"), F.col("ai_title")).cast("long").alias("rank"))


def orphan_transcripts(spark, sf):
    """Transcripts an account does not list."""
    return relink.scan_orphans(_transcripts(spark, sf)[0], m.index_entries(spark, sf), "ASIA").select(
        "session_id", "title", "title_source", "elsewhere", "size_bytes")


def create_plan(spark, sf):
    """Records to create for orphans, or why not."""
    orphans = relink.scan_orphans(_transcripts(spark, sf)[0], m.index_entries(spark, sf))
    plan = relink.plan_create_records(orphans, "ASIA", "/idx/ASIA/main")
    record = lambda path: F.get_json_object("record_json", path)
    return plan.select("kind", "session_id", "title", "reason", record("$.createdAt").cast("long").alias("created_ms"),
                       record("$.cliSessionId").alias("cli_session_id"), record("$.permissionMode").alias("permission_mode"))


def created_records(spark, sf):
    """Outcomes of creating them."""
    transcripts = _transcripts(spark, sf)[0]
    entries = m.index_entries(spark, sf)
    plan = relink.plan_create_records(relink.scan_orphans(transcripts, entries), "ASIA", "/idx/ASIA/main")
    there = transcripts.where("model <> '3-MEDIUM'")
    return store.summarize_results(relink.apply_create(plan, there, entries))


def transcript_descriptions(spark, sf):
    """First folder, last model of every transcript."""
    lines = jsonl.classify(m.transcript_lines(spark, sf))
    inventory = lines.select("file_path").distinct().select(
        "file_path", F.lit("main").alias("kind"), F.lit("s").alias("file_session_id"), F.lit("p").alias("project_dir"),
        F.lit(1).alias("size_bytes"), F.lit(0).cast("timestamp").alias("mtime"))
    facts, _titles = relink.describe_transcripts(lines, inventory)
    return facts.select("file_path", "cwd", "model")


def transcript_meta(spark, sf):
    """Listing record of every transcript."""
    lines = jsonl.classify(m.transcript_lines(spark, sf))
    inventory = lines.groupBy("file_path").agg(F.sum(F.octet_length("raw") + 1).alias("size_bytes")).select(
        "file_path", F.lit("main").alias("kind"), F.lit("file").alias("file_session_id"), F.lit("-p").alias("project_dir"), F.lit("/").alias("root"),
        "size_bytes", F.lit(0).cast("timestamp").alias("mtime"))
    return ls.session_meta(lines, inventory).select("file_path", "session_id", "project_path", "project_path_decoded", "model", "updated_at")


QUERIES = {f.__name__: f for f in (
    broken_records, relink_scan, relink_repairs, repaired_index, title_candidates, title_ranks, orphan_transcripts, create_plan,
    created_records, transcript_descriptions, transcript_meta)}

_T = (f"WITH {m.INDEX_ENTRIES}, transcripts AS (SELECT '/t/' || o_orderkey || '.jsonl' AS file_path, o_orderkey::VARCHAR AS session_id, '/' || p_type || '/' || p_brand AS folder, "
      "round(o_totalprice * 100)::BIGINT AS size_bytes, o_orderdate AS mtime, CASE WHEN o_orderstatus <> 'P' THEN p_name END AS custom_title, "
      "upper(replace(p_name, ' ', '-')) AS ai_title, p_name, CASE WHEN o_orderpriority <> '5-LOW' THEN '/' || p_type || '/' || p_brand END AS cwd, o_orderpriority AS model "
      "FROM orders JOIN part ON p_partkey = o_custkey)")
_ORPHANS = "orphans AS (SELECT *, coalesce(custom_title, ai_title) AS title FROM transcripts WHERE session_id NOT IN (SELECT cli_session_id FROM index_entries WHERE cli_session_id IS NOT NULL))"
_WHY = "CASE WHEN cwd IS NULL THEN 'no working directory' WHEN model = '2-HIGH' THEN 'transcript is damaged' END"
_PARSED = f"WITH {m.TRANSCRIPT_LINES}"
# Records choose one after the other, all accounts side by side: every step has
# the sessions its account has taken so far.
_WALK = (
    _T.replace("WITH ", "WITH RECURSIVE ", 1) + ", "
    "asking AS (SELECT *, row_number() OVER (PARTITION BY account_uuid ORDER BY index_path) AS k FROM index_entries WHERE kind = 'session' AND cli_session_id IS NULL), "
    "held AS (SELECT DISTINCT account_uuid, cli_session_id AS session_id FROM index_entries WHERE kind = 'session' AND cli_session_id IS NOT NULL), "
    "offers AS (SELECT a.account_uuid, a.k, t.session_id, t.custom_title IS NOT NULL AS typed, t.folder = a.project_path AS inside, "
    "row_number() OVER (PARTITION BY a.account_uuid, a.k ORDER BY (t.folder = a.project_path) DESC, mtime DESC, size_bytes DESC, file_path) AS place "
    "FROM asking a JOIN transcripts t ON t.p_name = a.title ANTI JOIN held h ON h.account_uuid = a.account_uuid AND h.session_id = t.session_id), "
    "wishes AS (SELECT a.account_uuid, a.k, list({'s': session_id, 'f': inside} ORDER BY place) FILTER (typed) AS typed, "
    "list({'s': session_id, 'f': inside} ORDER BY place) FILTER (NOT typed) AS auto FROM asking a LEFT JOIN offers o ON o.account_uuid = a.account_uuid AND o.k = a.k GROUP BY 1, 2), "
    "walk AS (SELECT DISTINCT account_uuid, 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::VARCHAR AS session_id, NULL::VARCHAR AS match, NULL::BOOLEAN AS in_folder, 0::BIGINT AS n, 0::BIGINT AS n_in FROM asking "
    "UNION ALL SELECT account_uuid, k, CASE WHEN len(best) > 0 THEN list_append(taken, best[1].s) ELSE taken END, best[1].s, "
    "CASE WHEN len(typed) > 0 THEN 'custom' WHEN len(best) > 0 THEN 'ai~' END, best[1].f, len(best), len(list_filter(best, lambda x: x.f)) FROM ("
    "SELECT *, CASE WHEN len(typed) > 0 THEN typed ELSE auto END AS best FROM (SELECT w.account_uuid, r.k, w.taken, "
    "coalesce(list_filter(r.typed, lambda x: NOT list_contains(w.taken, x.s)), []) AS typed, coalesce(list_filter(r.auto, lambda x: NOT list_contains(w.taken, x.s)), []) AS auto "
    "FROM walk w JOIN wishes r ON r.account_uuid = w.account_uuid AND r.k = w.k + 1))), "
    "relinked AS (SELECT a.index_path, a.account_uuid, a.title, w.session_id AS best_session_id, w.match, w.in_folder, w.n AS n_matches, "
    "CASE WHEN w.session_id IS NULL THEN 'none' WHEN w.n = 1 OR (w.in_folder AND w.n_in = 1) THEN 'strong' ELSE 'likely' END AS confidence "
    "FROM asking a JOIN walk w ON w.account_uuid = a.account_uuid AND w.k = a.k)"
)

SQL = {
    "broken_records": f"{_T} SELECT index_path, account_uuid, title, true AS missing_pointer, false AS missing_cwd FROM index_entries WHERE kind = 'session' AND cli_session_id IS NULL",
    "relink_scan": f"{_WALK} SELECT * FROM relinked",
    "relink_repairs": f"{_WALK} SELECT CASE WHEN best_session_id IS NULL THEN 'blocked' ELSE 'repair' END AS kind, confidence, count(*) AS n_actions FROM relinked GROUP BY 1, 2",
    "repaired_index": f"""{_WALK} SELECT count(*) AS n_rows, count(coalesce(e.cli_session_id, r.best_session_id)) AS n_pointers, 'after' AS part
          FROM index_entries e LEFT JOIN relinked r ON r.index_path = e.index_path WHERE e.kind = 'session'
        UNION ALL SELECT count(*), 0, 'backup' FROM relinked WHERE best_session_id IS NOT NULL
        UNION ALL SELECT count(*), 0, CASE WHEN best_session_id IS NULL THEN 'blocked' ELSE 'repaired' END AS part FROM relinked GROUP BY 3""",
    "title_candidates": f"""{_T}, hits AS (SELECT e.index_path, t.session_id, CASE WHEN t.custom_title IS NOT NULL THEN 0 ELSE 1 END AS tier, CASE WHEN t.folder = e.project_path THEN 0 ELSE 1 END AS f, mtime, size_bytes, t.file_path
          FROM index_entries e JOIN transcripts t ON t.p_name = e.title WHERE e.kind = 'session' AND e.cli_session_id IS NULL
          AND (e.account_uuid, t.session_id) NOT IN (SELECT (account_uuid, cli_session_id) FROM index_entries WHERE kind = 'session' AND cli_session_id IS NOT NULL)),
        top AS (SELECT *, min(tier) OVER (PARTITION BY index_path) AS best FROM hits)
        SELECT index_path, place, session_id FROM (SELECT index_path, session_id, row_number() OVER (PARTITION BY index_path ORDER BY f, mtime DESC, size_bytes DESC, file_path) - 1 AS place
          FROM top WHERE tier = best) WHERE place < 5""",
    "title_ranks": f"""{_T} SELECT index_path, CASE WHEN lower(title) <> lower(replace(ai_title, '-', ' ')) THEN NULL WHEN custom_title IS NOT NULL THEN 0 ELSE 3 END::BIGINT AS rank
        FROM index_entries e JOIN transcripts t ON t.session_id = e.cli_session_id""",
    "orphan_transcripts": f"""{_T} SELECT session_id, coalesce(custom_title, ai_title) AS title, CASE WHEN custom_title IS NULL THEN 'auto' ELSE 'user' END AS title_source,
        session_id IN (SELECT cli_session_id FROM index_entries WHERE cli_session_id IS NOT NULL) AS elsewhere, size_bytes FROM transcripts
        WHERE session_id NOT IN (SELECT cli_session_id FROM index_entries WHERE cli_session_id IS NOT NULL AND account_uuid = 'ASIA')""",
    "create_plan": f"""{_T}, {_ORPHANS} SELECT CASE WHEN {_WHY} IS NULL THEN 'create' ELSE 'blocked' END AS kind, session_id, title, {_WHY} AS reason,
        CASE WHEN {_WHY} IS NULL THEN epoch_ms(mtime) END AS created_ms, CASE WHEN {_WHY} IS NULL THEN session_id END AS cli_session_id,
        CASE WHEN {_WHY} IS NULL THEN 'auto' END AS permission_mode FROM orphans""",
    "created_records": f"""{_T}, {_ORPHANS} SELECT CASE WHEN {_WHY} IS NOT NULL THEN 'blocked' WHEN model = '3-MEDIUM' THEN 'skipped' ELSE 'created' END AS applied, count(*) AS n_actions FROM orphans GROUP BY 1""",
    "transcript_descriptions": f"""{_PARSED} SELECT file_path, CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN '/work/' || arg_min(left(text, 2), line_no) FILTER (status = 'ok') END AS cwd,
        'm' || (arg_max(length(text), line_no) FILTER (status = 'ok') % 3) AS model FROM gated GROUP BY 1""",
    "transcript_meta": f"""{_PARSED} SELECT file_path, coalesce(min(conv_id) FILTER (status = 'ok')::VARCHAR, 'file') AS session_id,
        CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN '/work/' || arg_min(left(text, 2), line_no) FILTER (status = 'ok') END AS project_path, '/p' AS project_path_decoded,
        'm' || (arg_max(length(text), line_no) FILTER (status = 'ok') % 3) AS model, '1970-01-01T00:00:00.000Z' AS updated_at FROM gated GROUP BY 1""",
}
