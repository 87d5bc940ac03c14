"""Per-account indexes: listing, ownership, copying and removing records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.catalog import models as m
from sessionlake.operators import accounts as ac, listing as ls
from sessionlake.plans import index_sync, store
from sessionlake.session import shared
from sessionlake.sources import index_files


def index_records(spark, sf):
    """The records of every usable account's history folder."""
    records, _ = index_sync.account_indexes(m.index_entries(spark, sf), m.index_accounts(spark, sf))
    return records.select("account_uuid", "desktop_session_id", "cli_session_id", "title", "index_path")


def index_tombstones(spark, sf):
    """G21, P14."""
    return index_sync.account_indexes(m.index_entries(spark, sf), m.index_accounts(spark, sf))[1]


def index_account_summary(spark, sf):
    """G11."""
    return ac.summarize_index(m.index_entries(spark, sf))


def transcript_claims(spark, sf):
    """Accounts listing each transcript, and its most recent entry."""
    out = ls.index_summary(ls.index_claims(m.index_entries(spark, sf)))
    return out.select("cli_session_id", "n_accounts", "n_records", "only_account", F.col("best.title").alias("title"),
                      F.col("best.desktop_session_id").alias("desktop_session_id"))


def session_listing(spark, sf):
    """Transcripts with sub-agents, warnings and owner."""
    sessions, _ = m.listing(spark, sf)
    return sessions.select("file_path", "session_id", "project_path", "title", "model", "updated_at", "size_bytes", "integrity",
                           "sub_agent_count", "owner_account", "owner_source", "n_accounts", "desktop_session_id", "is_archived")


def scan_totals(spark, sf):
    """A3, G8."""
    return ls.scan_totals(m.listing(spark, sf)[0], "project_path")


def owner_accounts(spark, sf):
    """Sessions, exclusive sessions and bytes per account."""
    sessions, claims = m.listing(spark, sf)
    return ls.owner_accounts(ls.session_claims(shared(sessions, "listing"), claims), "ASIA")


def attribution_counts(spark, sf):
    """G10."""
    return ls.attribution_counts(m.listing(spark, sf)[0])


def missing_transcripts(spark, sf):
    """Transcripts the index names and no order of the open book has."""
    on_disk = m.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("session_id"))
    return ls.missing_transcripts(m.index_entries(spark, sf), on_disk)


def account_histories(spark, sf):
    """Every account's history, with or without transcript."""
    sessions, _ = m.listing(spark, sf)
    disk = sessions.where("integrity <> 'damaged'").withColumn("uid", F.col("file_path"))
    out = ls.account_history(m.index_entries(spark, sf), m.index_accounts(spark, sf), disk)
    return out.select("uid", "account_uuid", "session_id", "title", "size_bytes", "integrity", "has_transcript", "refused")


def _owner_lines(spark, sf):
    """Rows of owner records: every order's file names its customer's segment."""
    o = m.table(spark, sf, "orders").join(m.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(
        F.lit('{"type":"bridge-session","ownerAccountUuid":"'), "c_mktsegment", F.lit('","ownerOrganizationUuid":"'), F.col("c_nationkey"), F.lit('"}')))
    return o.select(F.concat(F.lit("/f/"), "o_custkey").alias("file_path"), F.col("o_orderkey").alias("line_no"),
                    F.coalesce(raw, F.lit('{"type":"user"}')).alias("raw"))


def file_owners(spark, sf):
    """Last owner row of each customer's file."""
    return ls.file_owners(_owner_lines(spark, sf))


def attributed_accounts(spark, sf):
    """Files and bytes per recorded owner."""
    lines = _owner_lines(spark, sf)
    files = lines.groupBy("file_path").agg(F.sum(F.octet_length("raw")).alias("size_bytes"))
    return ls.attribute_accounts(ls.file_owners(lines, "first"), files).select("account_uuid", "session_count", "bytes")


def owner_pairs(spark, sf):
    """First organisation seen with each account."""
    return ls.owner_pairs(ls.file_owners(_owner_lines(spark, sf)))


def org_folders(spark, sf):
    """Sessions and tombstones per organisation folder."""
    files = m.index_entries(spark, sf).select(F.col("index_path").alias("file_path"))
    dirs = m.table(spark, sf, "region").select("r_name", F.explode(F.array(F.lit("main"), F.lit("other"), F.lit("empty"))).alias("organization_uuid")).select(
        F.concat(F.lit("/idx/"), "r_name", F.lit("/"), "organization_uuid").alias("dir"), F.col("r_name").alias("account_uuid"), "organization_uuid")
    return index_files.count_org_entries(dirs, files).select("account_uuid", "organization_uuid", "session_count", "deleted_count")


def _supplier_folders(spark, sf):
    """Suppliers as organisation folders of accounts (nations): a negative
    balance means an empty folder; the key gives the birth time."""
    s = m.table(spark, sf, "supplier")
    full = F.col("s_acctbal") > 6000
    return s.select(
        F.col("s_nationkey").cast("string").alias("account_uuid"), F.col("s_name").alias("organization_uuid"), F.col("s_name").alias("dir"),
        F.when(full, F.col("s_suppkey")).otherwise(0).alias("session_count"), F.lit(0).cast("long").alias("deleted_count"),
        (F.col("s_suppkey") * 100).alias("created_ms"), F.lit(3000).cast("long").alias("account_created_ms"))


def history_folders(spark, sf):
    """Which folder holds each account's history, and how it is known."""
    folders = _supplier_folders(spark, sf)
    nations = m.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("account_uuid"), "n_regionkey")
    biggest = m.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("account_uuid")).agg(F.max("s_name").alias("organization_uuid"))
    hint = lambda region: biggest.join(nations.where(F.col("n_regionkey") == region), "account_uuid").select("account_uuid", "organization_uuid")
    return ac.resolve_history(folders, hint(0), hint(1), hint(2), nations).select(
        "account_uuid", "history_org", "confidence", "reason", "ambiguous", "n_folders", "session_count")


def _people(spark, sf):
    c = m.table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("account_uuid"),
        F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit("@x"))).alias("email"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("display_name"), F.col("c_mktsegment").alias("organization_name"))


def account_labels(spark, sf):
    """Display name and its source."""
    people = _people(spark, sf)
    accounts = people.select("account_uuid")
    custom = m.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("account_uuid"), F.col("s_name").alias("label"))
    signed = people.where("organization_name = 'MACHINERY'")
    known = people.where("organization_name <> 'MACHINERY'")
    return ac.describe_accounts(accounts, custom, known, signed).select("account_uuid", "label", "label_source", "is_current")


def learned_identities(spark, sf):
    """Learning never loses a name."""
    people = _people(spark, sf)
    known = people.where("organization_name <> 'FURNITURE'")
    seen = people.where("organization_name <> 'MACHINERY'").withColumn("email", F.lit(None).cast("string")).withColumn(
        "display_name", F.when(F.length("account_uuid") > 2, F.concat(F.lit("new "), "account_uuid")))
    return ac.learn_identities(known, seen).select("account_uuid", "email", "display_name")


def identity_documents(spark, sf):
    """Identity fields from configuration documents."""
    c = m.table(spark, sf, "customer")
    raw = F.to_json(F.struct(F.lit("m").alias("userID"), F.struct(
        F.rpad(F.col("c_custkey").cast("string"), 36, "0").alias("accountUuid"), F.col("c_name").alias("emailAddress"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("fullName")).alias("oauthAccount")))
    docs = c.select(
        F.concat(F.lit("/a/"), F.rpad(F.col("c_nationkey").cast("string"), 36, "0"), F.lit("/"), F.rpad(F.lit("1"), 36, "0"), F.lit("/s/c/"), "c_custkey").alias("file_path"),
        F.octet_length(raw).alias("size_bytes"), raw.alias("raw"))
    return index_files.harvest_identities(docs).select("account_uuid", "email", "display_name")


def sync_all_plan(spark, sf):
    """The union of all records for every account."""
    plan = index_sync.plan_sync_all(m.index_entries(spark, sf), m.index_accounts(spark, sf))
    return plan.select("kind", "cli_session_id", "desktop_session_id", "source_account", "target_account", "source_path", "was_tombstoned", "reason",
                       (F.col("new_record_id").isNotNull()).alias("minted"))


def sync_all_summary(spark, sf):
    """G16 with deletions undone."""
    plan = index_sync.plan_sync_all(m.index_entries(spark, sf), m.index_accounts(spark, sf), None, True)
    return store.summarize_plan(plan, "target_account")


def _requests(spark, sf):
    return m.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("cli_session_id"))


def migrate_plan(spark, sf):
    """Urgent orders into one account, and into one that is not resolved."""
    entries, accounts = m.index_entries(spark, sf), m.index_accounts(spark, sf)
    plan = index_sync.plan_migrate(_requests(spark, sf), "ASIA", entries, accounts).unionByName(
        index_sync.plan_migrate(_requests(spark, sf), "MIDDLE EAST", entries, accounts))
    return plan.select("kind", "cli_session_id", "desktop_session_id", "source_account", "target_account", "source_path", "reason")


def unlink_plan(spark, sf):
    """Urgent orders out of one account, and out of one that is not resolved."""
    entries, accounts = m.index_entries(spark, sf), m.index_accounts(spark, sf)
    plan = index_sync.plan_unlink(_requests(spark, sf), "EUROPE", entries, accounts).unionByName(
        index_sync.plan_unlink(_requests(spark, sf), "MIDDLE EAST", entries, accounts))
    return plan.select("kind", "cli_session_id", "desktop_session_id", "target_account", "tombstone_path", "also_in", "n_also_in", "reason")


def index_after_sync(spark, sf):
    """Entries per account and kind after a union that undoes deletions."""
    entries, accounts = m.index_entries(spark, sf), m.index_accounts(spark, sf)
    plan = shared(index_sync.plan_sync_all(entries, accounts, None, True), "plan")
    done = index_sync.decide(plan, entries.select("index_path"))
    after, backup = index_sync.apply_to_index(done, entries, accounts, F.lit(0).cast("timestamp"))
    count = lambda f, part: f.groupBy("account_uuid", "kind").agg(
        F.count("*").alias("n_entries"), F.count("cli_session_id").alias("n_pointers")).withColumn("part", F.lit(part))
    return count(after, "after").unionByName(count(backup, "backup"))


def index_after_unlink(spark, sf):
    """Entries per account and kind after a removal."""
    entries, accounts = m.index_entries(spark, sf), m.index_accounts(spark, sf)
    plan = shared(index_sync.plan_unlink(_requests(spark, sf), "EUROPE", entries, accounts), "plan")
    done = index_sync.decide(plan, entries.select("index_path"))
    after, backup = index_sync.apply_to_index(done, entries, accounts, F.lit(0).cast("timestamp"))
    count = lambda f, part: f.groupBy("account_uuid", "kind").agg(F.count("*").alias("n_entries")).withColumn("part", F.lit(part))
    return count(after, "after").unionByName(count(backup, "backup"))


QUERIES = {f.__name__: f for f in (
    index_records, index_tombstones, index_account_summary, transcript_claims, session_listing, scan_totals, owner_accounts,
    attribution_counts, missing_transcripts, account_histories, file_owners, attributed_accounts, owner_pairs, org_folders,
    history_folders, account_labels, learned_identities, identity_documents, sync_all_plan, sync_all_summary, migrate_plan,
    unlink_plan, index_after_sync, index_after_unlink)}

_IDX = f"WITH {m.INDEX_ENTRIES}"
_LIST = f"WITH {m.LISTING}"
_OWNERS = """WITH owner_lines AS (SELECT '/f/' || o_custkey AS file_path, o_orderkey AS line_no, c_mktsegment AS account_uuid, c_nationkey::VARCHAR AS organization_uuid,
   o_orderpriority = '1-URGENT' AS owned FROM orders JOIN customer ON c_custkey = o_custkey)"""
_BEST = """ keyed AS (SELECT r.*, coalesce(cli_session_id, 'record:' || desktop_session_id) AS key, position FROM records r JOIN accounts USING (account_uuid)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY last_activity_at DESC, position, index_path) AS k FROM keyed) WHERE k = 1),
 pairs AS (SELECT b.cli_session_id, b.desktop_session_id, b.account_uuid AS source_account, t.account_uuid AS target_account, b.index_path AS source_path
   FROM best b JOIN accounts t ON t.account_uuid <> b.account_uuid)"""
_CLASSIFY = """ probed AS (SELECT p.*, EXISTS (SELECT 1 FROM listed l WHERE l.account_uuid = p.target_account AND l.cli_session_id = p.cli_session_id) AS has_cli,
   EXISTS (SELECT 1 FROM records r WHERE r.account_uuid = p.target_account AND r.desktop_session_id = p.desktop_session_id) AS has_rec,
   EXISTS (SELECT 1 FROM tombstones t WHERE t.account_uuid = p.target_account AND 'local_' || t.bare = p.desktop_session_id) AS deleted FROM pairs p),
 classed AS (SELECT *, CASE WHEN cli_session_id IS NOT NULL THEN has_cli ELSE has_rec END AS present FROM probed)"""
_PEOPLE = """WITH people AS (SELECT c_custkey::VARCHAR AS account_uuid, CASE WHEN c_acctbal > 0 THEN c_name || '@x' END AS email,
   CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS display_name, c_mktsegment AS organization_name FROM customer)"""
_REQUESTS = "requests AS (SELECT o_orderkey::VARCHAR AS cli_session_id FROM orders WHERE o_orderpriority = '1-URGENT')"

SQL = {
    "index_records": f"{_IDX} SELECT account_uuid, desktop_session_id, cli_session_id, title, index_path FROM records",
    "index_tombstones": f"{_IDX} SELECT account_uuid, bare AS bare_id FROM tombstones",
    "index_account_summary": f"""{_IDX} SELECT account_uuid, count(DISTINCT organization_uuid) AS organizations, count(*) FILTER (kind = 'session') AS session_count,
        count(*) FILTER (kind = 'deleted') AS deleted_count, count(*) FILTER (kind = 'session' AND is_archived) AS archived_count,
        count(cli_session_id) FILTER (kind = 'session') AS with_transcript FROM index_entries GROUP BY 1""",
    "transcript_claims": f"{_LIST} SELECT cli_session_id, n_accounts, n_records, only_account, b.title, b.desktop_session_id FROM claimed JOIN best b USING (cli_session_id)",
    "session_listing": f"""{_LIST} SELECT file_path, session_id, project_path, title, model, updated_at, size_bytes, integrity, sub_agent_count, owner_account,
        owner_source, n_accounts, desktop_session_id, is_archived FROM listing""",
    "scan_totals": f"""{_LIST} SELECT project_path, count(*) AS sessions, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (integrity IN ('damaged', 'unreadable')) AS damaged
        FROM listing GROUP BY ROLLUP (project_path)""",
    "owner_accounts": f"""{_LIST} SELECT account_uuid, count(*) AS session_count, count(*) FILTER (n_accounts = 1) AS exclusive_count, sum(size_bytes)::BIGINT AS bytes,
        account_uuid = 'ASIA' AS is_current FROM (SELECT c.account_uuid, l.n_accounts, size_bytes FROM listing l JOIN claims c ON c.cli_session_id = l.session_id
        UNION ALL SELECT owner_account, 1, size_bytes FROM listing WHERE n_accounts = 0 AND owner_account IS NOT NULL) GROUP BY account_uuid""",
    "attribution_counts": f"""{_LIST} SELECT root, count(*) FILTER (owner_account IS NULL AND n_accounts = 0) AS unattributed, count(*) FILTER (n_accounts > 1) AS shared_across_accounts FROM listing GROUP BY 1""",
    "missing_transcripts": f"""{_IDX} SELECT DISTINCT cli_session_id AS session_id FROM index_entries WHERE cli_session_id IS NOT NULL
        AND cli_session_id NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderstatus <> 'P')""",
    "account_histories": f"""{_LIST} SELECT coalesce(l.file_path, 'index:' || r.desktop_session_id) AS uid, r.account_uuid, coalesce(r.cli_session_id, r.desktop_session_id) AS session_id,
        coalesce(r.title, l.title) AS title, l.size_bytes, coalesce(l.integrity, 'no-transcript') AS integrity, l.file_path IS NOT NULL AS has_transcript, NULL AS refused
        FROM records r LEFT JOIN (SELECT * FROM listing WHERE integrity <> 'damaged') l ON l.session_id = r.cli_session_id
        UNION ALL SELECT NULL, 'MIDDLE EAST', NULL, NULL, NULL, NULL, false, 'several-populated'""",
    "file_owners": f"{_OWNERS} SELECT file_path, arg_max(account_uuid, line_no) AS account_uuid, arg_max(organization_uuid, line_no) AS organization_uuid FROM owner_lines WHERE owned GROUP BY 1",
    "attributed_accounts": f"""{_OWNERS}, f AS (SELECT file_path, arg_min(account_uuid, line_no) FILTER (owned) AS account_uuid,
        sum(CASE WHEN owned THEN strlen('{{"type":"bridge-session","ownerAccountUuid":"' || account_uuid || '","ownerOrganizationUuid":"' || organization_uuid || '"}}') ELSE 15 END)::BIGINT AS b FROM owner_lines GROUP BY 1)
        SELECT account_uuid, count(*) AS session_count, sum(b)::BIGINT AS bytes FROM f GROUP BY 1""",
    "owner_pairs": f"""{_OWNERS}, o AS (SELECT file_path, arg_max(account_uuid, line_no) AS account_uuid, arg_max(organization_uuid, line_no) AS organization_uuid FROM owner_lines WHERE owned GROUP BY 1)
        SELECT account_uuid, arg_min(organization_uuid, file_path) AS organization_uuid FROM o GROUP BY 1""",
    "org_folders": f"""{_IDX}, dirs AS (SELECT r_name AS account_uuid, unnest(['main', 'other', 'empty']) AS organization_uuid FROM region)
        SELECT account_uuid, organization_uuid, count(e.kind) FILTER (e.kind = 'session') AS session_count, count(e.kind) FILTER (e.kind = 'deleted') AS deleted_count
        FROM dirs LEFT JOIN index_entries e USING (account_uuid, organization_uuid) GROUP BY 1, 2""",
    "history_folders": """WITH f AS (SELECT s_nationkey::VARCHAR AS account_uuid, s_name AS org, s_acctbal > 6000 AND s_suppkey > 0 AS full_, s_suppkey, abs(s_suppkey * 100 - 3000) <= 2000 AS born,
          CASE WHEN s_acctbal > 6000 THEN s_suppkey ELSE 0 END AS n FROM supplier),
        g AS (SELECT n_nationkey::VARCHAR AS account_uuid, n_regionkey, count(org) AS n_folders, max(org) AS biggest, count(*) FILTER (full_) AS np, min(org) FILTER (full_) AS po,
          min(org) AS ao, count(*) FILTER (born) AS nb, min(org) FILTER (born) AS bo, coalesce(sum(n), 0)::BIGINT AS session_count FROM nation LEFT JOIN f ON f.account_uuid = n_nationkey::VARCHAR GROUP BY 1, 2),
        r AS (SELECT *, CASE WHEN n_folders = 0 THEN 'no-folder' WHEN n_regionkey = 0 THEN 'signed-in' WHEN n_regionkey = 1 THEN 'account-config' WHEN n_regionkey = 2 THEN 'transcript'
          WHEN np = 1 THEN 'populated' WHEN np > 1 THEN 'several-populated' WHEN n_folders = 1 THEN 'only-folder' WHEN nb = 1 THEN 'born-together' ELSE 'several-empty' END AS reason FROM g)
        SELECT account_uuid, CASE WHEN reason IN ('signed-in', 'account-config', 'transcript') THEN biggest WHEN reason = 'populated' THEN po WHEN reason = 'only-folder' THEN ao
          WHEN reason = 'born-together' THEN bo END AS history_org, CASE WHEN reason IN ('no-folder', 'several-populated', 'several-empty') THEN 'none' ELSE reason END AS confidence,
          reason, reason IN ('no-folder', 'several-populated', 'several-empty') AS ambiguous, n_folders, session_count FROM r""",
    "account_labels": f"""{_PEOPLE} SELECT account_uuid, coalesce(s_name, email, display_name, left(account_uuid, 8)) AS label,
        CASE WHEN s_name IS NOT NULL THEN 'custom' WHEN coalesce(email, display_name) IS NULL THEN 'uuid' WHEN organization_name = 'MACHINERY' THEN 'signed-in' ELSE 'learned' END AS label_source,
        organization_name = 'MACHINERY' AS is_current FROM people LEFT JOIN supplier ON s_suppkey::VARCHAR = account_uuid""",
    "learned_identities": f"""{_PEOPLE} SELECT account_uuid,
        CASE WHEN organization_name = 'MACHINERY' OR (organization_name <> 'FURNITURE' AND coalesce(email, display_name) IS NOT NULL AND length(account_uuid) <= 2) THEN email END AS email,
        CASE WHEN organization_name = 'MACHINERY' OR (organization_name <> 'FURNITURE' AND coalesce(email, display_name) IS NOT NULL AND length(account_uuid) <= 2) THEN display_name
             WHEN length(account_uuid) > 2 THEN 'new ' || account_uuid END AS display_name FROM people""",
    "identity_documents": """SELECT rpad(k, 36, '0') AS account_uuid, email, display_name FROM (SELECT c_custkey::VARCHAR AS k, c_name AS email, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS display_name,
        row_number() OVER (PARTITION BY rpad(c_custkey::VARCHAR, 36, '0') ORDER BY '/s/c/' || c_custkey) AS n FROM customer
        WHERE rpad(c_custkey::VARCHAR, 36, '0') = rpad(c_nationkey::VARCHAR, 36, '0')) WHERE n = 1""",
    "sync_all_plan": f"""{_IDX}, {_BEST}, {_CLASSIFY} SELECT CASE WHEN present THEN 'already-present' WHEN deleted THEN 'tombstoned' ELSE 'copy' END AS kind, cli_session_id, desktop_session_id,
        source_account, target_account, source_path, false AS was_tombstoned,
        CASE WHEN present AND cli_session_id IS NOT NULL THEN 'lists this transcript' WHEN present THEN 'lists this record' WHEN deleted THEN 'deleted here'
             WHEN has_rec THEN 'record id in use for another conversation' END AS reason, NOT present AND NOT deleted AND has_rec AS minted FROM classed
        UNION ALL SELECT 'blocked', NULL, NULL, NULL, 'MIDDLE EAST', NULL, false, 'several-populated', false""",
    "sync_all_summary": f"""{_IDX}, {_BEST}, {_CLASSIFY} SELECT kind, count(*) AS n_actions, count(DISTINCT target_account) AS n_targets FROM (
        SELECT CASE WHEN present THEN 'already-present' ELSE 'copy' END AS kind, target_account FROM classed UNION ALL SELECT 'blocked', 'MIDDLE EAST') GROUP BY 1""",
    "migrate_plan": f"""{_IDX}, {_REQUESTS}, src AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY cli_session_id ORDER BY position) AS k FROM listed l JOIN accounts USING (account_uuid)
          WHERE account_uuid <> 'ASIA') WHERE k = 1),
        pairs AS (SELECT cli_session_id, s.desktop_session_id, s.account_uuid AS source_account, 'ASIA' AS target_account, s.index_path AS source_path FROM requests JOIN src s USING (cli_session_id)), {_CLASSIFY}
        SELECT CASE WHEN present THEN 'already-present' WHEN deleted THEN 'tombstoned' ELSE 'copy' END AS kind, cli_session_id, desktop_session_id, source_account, target_account, source_path,
          CASE WHEN present THEN 'lists this transcript' WHEN deleted THEN 'deleted here' WHEN has_rec THEN 'record id in use for another conversation' END AS reason FROM classed
        UNION ALL SELECT CASE WHEN o.index_path IS NULL THEN 'blocked' ELSE 'already-present' END, r.cli_session_id, o.desktop_session_id, CASE WHEN o.index_path IS NOT NULL THEN 'ASIA' END, 'ASIA', o.index_path,
          CASE WHEN o.index_path IS NULL THEN 'no account lists it' ELSE 'lists this transcript' END
        FROM requests r LEFT JOIN (SELECT * FROM listed WHERE account_uuid = 'ASIA') o USING (cli_session_id) WHERE cli_session_id NOT IN (SELECT cli_session_id FROM src)
        UNION ALL SELECT DISTINCT 'blocked', cli_session_id, NULL, NULL, 'MIDDLE EAST', NULL, 'several-populated' FROM requests""",
    "unlink_plan": f"""{_IDX}, {_REQUESTS} SELECT CASE WHEN l.index_path IS NULL THEN 'not-present' ELSE 'remove' END AS kind, cli_session_id, l.desktop_session_id, 'EUROPE' AS target_account,
        '/idx/EUROPE/main/deleted_' || substr(l.desktop_session_id, 7) AS tombstone_path,
        CASE WHEN l.index_path IS NOT NULL THEN o.names END AS also_in, CASE WHEN l.index_path IS NOT NULL THEN coalesce(o.n, 0) END AS n_also_in,
        CASE WHEN l.index_path IS NULL THEN 'not listed here' END AS reason
        FROM requests LEFT JOIN (SELECT * FROM listed WHERE account_uuid = 'EUROPE') l USING (cli_session_id)
        LEFT JOIN (SELECT cli_session_id, count(*) AS n, string_agg(account_uuid, ', ' ORDER BY account_uuid) AS names FROM listed WHERE account_uuid <> 'EUROPE' GROUP BY 1) o USING (cli_session_id)
        UNION ALL SELECT DISTINCT 'blocked', cli_session_id, NULL, 'MIDDLE EAST', NULL, NULL, NULL, 'several-populated' FROM requests""",
    "index_after_sync": f"""{_IDX}, {_BEST}, {_CLASSIFY}, moved AS (SELECT *, '/idx/' || target_account || '/main/' || CASE WHEN NOT deleted AND has_rec THEN 'new' || cli_session_id
            ELSE desktop_session_id END || '.json' AS dest FROM classed WHERE NOT present),
        fresh AS (SELECT * FROM moved WHERE dest NOT IN (SELECT index_path FROM index_entries)),
        gone AS (SELECT '/idx/' || target_account || '/main/deleted_' || substr(desktop_session_id, 7) AS p FROM fresh WHERE deleted)
        SELECT 'after' AS part, account_uuid, kind, count(*) AS n_entries, count(cli_session_id) AS n_pointers FROM (
          SELECT account_uuid, kind, cli_session_id FROM index_entries WHERE index_path NOT IN (SELECT p FROM gone)
          UNION ALL SELECT target_account, 'session', cli_session_id FROM fresh) GROUP BY account_uuid, kind
        UNION ALL SELECT 'backup', account_uuid, kind, count(*), 0 FROM index_entries WHERE index_path IN (SELECT p FROM gone) GROUP BY account_uuid, kind""",
    "index_after_unlink": f"""{_IDX}, {_REQUESTS}, gone AS (SELECT l.* FROM listed l JOIN requests USING (cli_session_id) WHERE account_uuid = 'EUROPE')
        SELECT 'after' AS part, account_uuid, kind, count(*) AS n_entries FROM (SELECT account_uuid, kind FROM index_entries WHERE index_path NOT IN (SELECT index_path FROM gone)
          UNION ALL SELECT 'EUROPE', 'deleted' FROM gone WHERE '/idx/EUROPE/main/deleted_' || substr(desktop_session_id, 7) NOT IN (SELECT index_path FROM index_entries)) GROUP BY account_uuid, kind
        UNION ALL SELECT 'backup', account_uuid, kind, count(*) FROM index_entries WHERE index_path IN (SELECT index_path FROM gone) GROUP BY account_uuid, kind""",
}
