"""Account sync, index plans, history folders and import rules on small cases."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import accounts as ac, content
from sessionlake.plans import importing, index_sync, store, sync

DAY = lambda n: datetime(2026, 1, n, tzinfo=timezone.utc)
ENTRY = ("kind string, account_uuid string, organization_uuid string, desktop_session_id string, cli_session_id string, title string, "
         "project_path string, is_archived boolean, last_activity_at timestamp, deleted_at timestamp, index_path string")


def record(account, rec, cli, day=1, org="o"):
    return ("session", account, org, f"local_{rec}", cli, f"title {cli}", "/w", False, DAY(day), None, f"/i/{account}/{org}/local_{rec}.json")


def tombstone(account, rec):
    return ("deleted", account, "o", rec, None, None, None, False, None, DAY(1), f"/i/{account}/o/deleted_{rec}")


@pytest.fixture
def accounts(spark):
    rows = [(a, n, a, "o", f"/i/{a}/o", False, "populated") for n, a in enumerate("abc")] + [("x", 9, "x", None, None, True, "several-populated")]
    return spark.createDataFrame(rows, "account_uuid string, position int, label string, history_org string, history_dir string, ambiguous boolean, reason string")


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_sync_all(spark, accounts):
    e = entries(spark, record("a", "r1", "s1", 1), record("b", "r1", "s1", 5), record("a", "r2", "s2"), tombstone("b", "r2"),
                record("b", "r3", "s3"), record("a", "r3", "s4"), record("a", "r9", "s9", org="other"))
    plan = index_sync.plan_sync_all(e, accounts)
    got = {(r.cli_session_id, r.target_account): r for r in plan.collect()}
    assert got[("s1", "a")].kind == "already-present" and got[("s1", "c")].kind == "copy"
    assert got[("s1", "c")].source_account == "b", "the most recently active copy is the source"
    assert got[("s2", "b")].kind == "tombstoned"
    clash = got[("s3", "a")]
    assert clash.kind == "copy" and clash.new_record_id and clash.dest_path == f"/i/a/o/{clash.new_record_id}.json"
    assert got[(None, "x")].kind == "blocked" and not any(k[0] == "s9" for k in got)
    restore = index_sync.plan_sync_all(e, accounts, spark.createDataFrame([("s2",)], "cli_session_id string"), True)
    done = index_sync.decide(restore, e.select("index_path"))
    after, backup = index_sync.apply_to_index(done, e, accounts)
    assert {r.index_path for r in backup.collect()} == {"/i/b/o/deleted_r2"}
    assert after.where("account_uuid = 'b' AND cli_session_id = 's2'").count() == 1
    again = index_sync.plan_sync_all(after, accounts, spark.createDataFrame([("s2",)], "cli_session_id string"))
    assert {r.kind for r in again.collect()} == {"already-present", "blocked"}


def test_single_account_has_nothing_to_combine(spark, accounts):
    e = entries(spark, record("a", "r1", "s1"))
    assert index_sync.plan_sync_all(e, accounts.where("account_uuid = 'a'")).count() == 0


def test_migrate_and_unlink(spark, accounts):
    e = entries(spark, record("a", "r1", "s1"), record("b", "r1", "s1"), record("c", "r2", "s2"))
    wanted = spark.createDataFrame([("s1",), ("s2",), ("nope",)], "cli_session_id string")
    got = {r.cli_session_id: (r.kind, r.source_account) for r in index_sync.plan_migrate(wanted, "c", e, accounts).collect()}
    assert got == {"s1": ("copy", "a"), "s2": ("already-present", "c"), "nope": ("blocked", None)}
    plan = index_sync.plan_unlink(wanted, "a", e, accounts)
    got = {r.cli_session_id: (r.kind, r.also_in) for r in plan.collect()}
    assert got == {"s1": ("remove", "b"), "s2": ("not-present", None), "nope": ("not-present", None)}
    after, backup = index_sync.apply_to_index(index_sync.decide(plan, e.select("index_path")), e, accounts)
    assert backup.count() == 1
    # The tombstone keeps the next union from copying the record back.
    back = index_sync.plan_sync_all(after, accounts)
    assert {(r.target_account, r.kind) for r in back.where("cli_session_id = 's1'").collect()} == {("a", "tombstoned"), ("c", "copy")}


def test_a_copy_never_overwrites_what_appeared_meanwhile(spark, accounts):
    e = entries(spark, record("a", "r1", "s1"))
    plan = index_sync.plan_sync_all(e, accounts)
    now = e.unionByName(entries(spark, record("b", "r1", "s8")))
    done = {r.target_account: r.applied for r in index_sync.decide(plan, now.select("index_path")).collect()}
    assert done == {"b": "skipped", "c": "written", "x": "blocked"}


FOLDER = "account_uuid string, organization_uuid string, dir string, session_count long, deleted_count long, created_ms long, account_created_ms long"


@pytest.mark.parametrize("rows, hints, org, why", [
    ([("o1", 1, 0, None), ("o2", 3, 0, None)], {"signed_in": "o2"}, "o2", "signed-in"),
    ([("o1", 1, 0, None), ("o2", 3, 0, None)], {"signed_in": "gone", "declared": "o1"}, "o1", "account-config"),
    ([("o1", 1, 0, None), ("o2", 3, 0, None)], {"transcript_pairs": "o1"}, "o1", "transcript"),
    ([("o1", 0, 0, None), ("o2", 0, 2, None)], {}, "o2", "populated"),
    ([("o1", 1, 0, None), ("o2", 3, 0, None)], {}, None, "several-populated"),
    ([("o1", 0, 0, None)], {}, "o1", "only-folder"),
    ([("o1", 0, 0, 9000), ("o2", 0, 0, 2500)], {}, "o2", "born-together"),
    ([("o1", 0, 0, 1000), ("o2", 0, 0, 2500)], {}, None, "several-empty"),
    ([("o1", 0, 0, None), ("o2", 0, 0, None)], {}, None, "several-empty"),
])
def test_history_folder(spark, rows, hints, org, why):
    data = [("a", o, f"/d/{o}", s, d, c, 1000) for o, s, d, c in rows]
    folders = spark.createDataFrame(data, FOLDER)
    hint = {k: spark.createDataFrame([("a", v)], "account_uuid string, organization_uuid string") for k, v in hints.items()}
    got = ac.resolve_history(folders, **hint).first()
    assert (got.history_org, got.reason, got.ambiguous) == (org, why, org is None)
    assert got.history_dir == (f"/d/{org}" if org else None)


def sessions_of(spark, spec):
    """spec: uid -> (root, session id, texts, integrity)."""
    data = [(u, i, "user", "text", t, None, None, None) for u, (_r, _s, texts, _i) in spec.items() for i, t in enumerate(texts)]
    messages = content.with_digest(spark.createDataFrame(
        data, "uid string, pos long, role string, type string, text string, tool_name string, tool_input string, tool_output string"))
    facts = spark.createDataFrame([(u, r, s, i, f"projects/p/{s}.jsonl", s, 1, DAY(n + 1)) for n, (u, (r, s, _t, i)) in enumerate(spec.items())],
                                  "uid string, root string, session_id string, integrity string, rel_path string, title string, size_bytes long, updated_at timestamp")
    return messages, facts.join(content.content_hash(messages, ["uid"]), "uid", "left")


def test_sync_plan_and_resolutions(spark):
    messages, facts = sessions_of(spark, {
        "a1": ("/A", "s1", "xy", "ok"), "b1": ("/B", "other-id", "xy", "ok"), "a2": ("/A", "s2", "ab", "ok"), "b2": ("/B", "s2", "abc", "ok"),
        "a3": ("/A", "s3", "q", "ok"), "b4": ("/B", "s4", "z", "damaged")})
    both = spark.createDataFrame([("/A", 0), ("/B", 1)], "root string, position int")
    plan = sync.plan_sync(both, facts, messages)
    got = {(r.kind, r.session_id, r.dest_root): r for r in plan.collect()}
    assert set(got) == {("already-everywhere", "s1", None), ("conflict", "s2", "/A"), ("conflict", "s2", "/B"), ("copy", "s3", "/B"), ("blocked", "s4", None)}
    assert got[("conflict", "s2", "/A")].recommendation == "keep-incoming"
    assert got[("conflict", "s2", "/B")].recommendation == "keep-existing"
    assert sync.plan_sync(both.where("root = '/A'"), facts, messages).count() == 0
    paths = facts.select(F.concat_ws("/", "root", "rel_path").alias("file_path"))
    none = spark.createDataFrame([], "session_id string, dest_root string, resolution string")
    done = {(r.session_id, r.dest_root): r.applied for r in sync.decide(plan, none, paths).collect()}
    assert done[("s2", "/A")] == "skipped-unresolved" and done[("s3", "/B")] == "copied"
    choice = spark.createDataFrame([("s2", "/A", "keep-incoming"), ("s2", "/B", "keep-both")], "session_id string, dest_root string, resolution string")
    outcomes = sync.decide(plan, choice, paths)
    files = facts.select("uid", F.concat_ws("/", "root", "rel_path").alias("file_path")).join(messages.select("uid", "pos", "text"), "uid").drop("uid")
    after, backup = sync.apply_to_files(outcomes, files)
    text = {}
    for r in after.orderBy("file_path", "pos").collect():
        text[r.file_path] = text.get(r.file_path, "") + r.text
    assert text["/A/projects/p/s2.jsonl"] == "abc" and text["/B/projects/p/s3.jsonl"] == "q"
    assert text["/B/projects/p/s2.jsonl"] == "abc" and text["/B/projects/p/s2--from-A.jsonl"] == "ab"
    assert {r.file_path for r in backup.collect()} == {"/A/projects/p/s2.jsonl"}
    assert {r.outcome for r in store.audit_rows(outcomes, "sync").collect()} >= {"copied", "overwritten", "written-alongside", "no-op", "blocked"}


def test_plans_are_saved_once(spark, tmp_path):
    plan = spark.createDataFrame([("copy", "s1")], "kind string, session_id string")
    saved = store.save_plan(plan, str(tmp_path / "plans"), "p1")
    assert saved.count() == 1
    with pytest.raises(Exception):
        store.save_plan(plan, str(tmp_path / "plans"), "p1")


def test_import_follows_position_not_session_id(spark):
    plan = spark.createDataFrame([(0, "s", "u0", "write", "/r/0", "d0", None), (1, "s", "u1", "write", "/r/1", "d1", None), (2, "t", "u2", "write", "/r/2", "d2", None)],
                                 "manifest_index long, session_id string, snapshot_uid string, kind string, dest_path string, raw_digest string, newer string")
    records = spark.createDataFrame([(0, "s"), (1, "s"), (2, "changed")], "manifest_index long, session_id string")
    none = spark.createDataFrame([], "manifest_index long, resolution string")
    restored = spark.createDataFrame([(0, "d0", "ok"), (1, "bad", "ok"), (2, "d2", "ok")], "manifest_index long, raw_digest string, integrity string")
    empty = spark.createDataFrame([], "file_path string")
    got = {r.manifest_index: (r.applied, r.write_path) for r in importing.decide(plan, records, none, empty, None, restored).collect()}
    assert got == {0: ("written", "/r/0"), 1: ("failed", None), 2: ("failed", None)}
    raw = spark.createDataFrame([("u0", 1, "zero"), ("u1", 1, "one")], "snapshot_uid string, line_no long, raw string")
    done = importing.decide(plan, records, none, empty)
    after, _ = importing.apply_to_files(done, raw, spark.createDataFrame([], "file_path string, line_no long, raw string"))
    assert {r.file_path: r.raw for r in after.collect()} == {"/r/0": "zero", "/r/1": "one"}, "two records of one id keep their own lines"
