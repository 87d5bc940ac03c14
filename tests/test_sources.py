"""Index files, inventories and sidecars read from disk."""

import json

from sessionlake.operators import listing as ls
from sessionlake.sources import index_files, inventory, jsonl

A, O1, O2 = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222", "33333333-3333-3333-3333-333333333333"


def put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def test_index(spark, tmp_path):
    put(tmp_path, f"{A}/{O1}/local_1.json", json.dumps({"sessionId": "local_1", "cliSessionId": "s1", "title": "T", "cwd": "/w", "originCwd": "/o",
                                                      "createdAt": 1700000000000, "lastActivityAt": "1700000000000", "isArchived": True, "completedTurns": 3}))
    put(tmp_path, f"{A}/{O1}/local_2.json", "{broken")
    put(tmp_path, f"{A}/{O1}/deleted_9", "1700000000000\n")
    put(tmp_path, f"{A}/{O1}/deleted_8", "")
    put(tmp_path, f"{A}/{O1}/other.txt", "x")
    put(tmp_path, f"not-a-uuid/{O1}/local_3.json", "{}")
    (tmp_path / A / O2).mkdir()
    entries, problems = index_files.read_index(spark, str(tmp_path))
    got = {r.desktop_session_id: r for r in entries.collect()}
    assert set(got) == {"local_1", "9", "8"}
    one = got["local_1"]
    assert (one.cli_session_id, one.project_path, one.worktree_cwd, one.is_archived, one.completed_turns) == ("s1", "/o", "/w", True, 3)
    assert one.created_at is not None and one.last_activity_at is None, "text is not a time"
    assert got["9"].deleted_at is not None and got["8"].deleted_at is None
    assert [p.index_path.rsplit("/", 1)[1] for p in problems.collect()] == ["local_2.json"]
    every = {(r.kind, r.desktop_session_id) for r in index_files.read_all_records(spark, str(tmp_path)).collect()}
    assert ("session", "local_3") in every and any(k == "unreadable" for k, _ in every)
    folders = {r.organization_uuid: (r.session_count, r.deleted_count) for r in index_files.list_org_folders(spark, str(tmp_path)).collect()}
    assert folders == {O1: (2, 2), O2: (0, 0)}


def test_transcripts_sidecars_and_listing(spark, tmp_path):
    row = json.dumps({"type": "user", "sessionId": "s1", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "x"}})
    title = json.dumps({"type": "custom-title", "customTitle": "Mine"})
    owner = json.dumps({"type": "bridge-session", "ownerAccountUuid": A, "ownerOrganizationUuid": O1})
    put(tmp_path, "projects/-w/s1.jsonl", "\n".join([row, title, json.dumps({"type": "ai-title", "aiTitle": "Auto"}), owner]) + "\n")
    put(tmp_path, "projects/-w/s2.jsonl", "")
    put(tmp_path, "projects/-w/s1/subagents/workflows/wf/agent-1.jsonl", row + "\n")
    put(tmp_path, "projects/-w/s1/subagents/workflows/wf/journal.jsonl", row + "\n")
    put(tmp_path, "todos/s1-agent-1.json", "[]")
    put(tmp_path, "file-history/s1/deep/file", "x")
    listed = inventory.list_transcripts(spark, str(tmp_path)).cache()
    assert sorted((r.kind, r.file_session_id, r.parent_session_id) for r in listed.collect() if r.kind != "main") == [
        ("agent", "agent-1", "s1"), ("journal", "journal", "s1")]
    lines = jsonl.read_jsonl(spark, str(tmp_path))
    meta = ls.session_meta(lines, listed)
    from sessionlake.operators import integrity

    report = integrity.scan_integrity(spark, str(tmp_path), listed)
    claims = ls.index_claims(spark.createDataFrame([], (
        "kind string, cli_session_id string, account_uuid string, organization_uuid string, index_path string, last_activity_at timestamp, "
        "title string, branch string, desktop_session_id string, is_archived boolean, project_path string")))
    got = {r.session_id: r for r in ls.list_sessions(meta, listed, claims, report, "t", "acct").collect()}
    assert (got["s1"].title, got["s1"].sub_agent_count, got["s1"].owner_account, got["s1"].owner_source) == ("Mine", 2, A, "transcript")
    assert got["s2"].integrity == "empty" and got["s2"].warnings == ["empty"]
    sampled = {r.session_id: r for r in ls.session_meta(lines, listed, sampled=True).collect()}
    assert sampled["s1"].title == "Mine" and sampled["s1"].created_at == "2026-01-01T00:00:00Z"
    files = inventory.classify_sidecars(inventory.list_files(spark, str(tmp_path)))
    from pyspark.sql import functions as F

    ids = listed.where("kind = 'main'").select("root", F.col("file_session_id").alias("session_id"))
    assert sorted((r.kind, r.session_id) for r in inventory.attach_sidecars(files, ids).collect()) == [("file-history", "s1"), ("todo", "s1")]
    owners = ls.file_owners(lines).collect()
    assert [(r.account_uuid, r.organization_uuid) for r in owners] == [(A, O1)]
