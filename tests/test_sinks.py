"""Native rows parse back to the messages they came from; snapshots restore."""

import json

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import content, integrity, normalize
from sessionlake.plans import store
from sessionlake.sinks import native, snapshot
from sessionlake.sources import jsonl

MESSAGES = "uid string, pos long, role string, type string, text string, tool_name string, tool_input string, tool_output string, row_uuid string, ts string"
TALK = [
    ("system", "text", 'be "brief"\n', None, None, None), ("user", "text", "hi", None, None, None),
    ("assistant", "thinking", "hm", None, None, None), ("assistant", "text", "so", None, None, None),
    ("assistant", "tool_use", None, "Read", '{"a":1}', None), ("tool", "tool_result", "out", None, '{"tool_use_id":"t9"}', '"out"'),
    ("assistant", "text", "a", None, None, None), ("assistant", "text", "b", None, None, None), ("assistant", "text", "c", None, None, None),
    ("user", "text", None, None, None, None),
]


@pytest.mark.parametrize("max_blocks", [10_000, 2])
def test_native_rows_round_trip(spark, max_blocks):
    msgs = spark.createDataFrame([("u", i, *m, f"id{i}", None) for i, m in enumerate(TALK)], MESSAGES)
    sessions = spark.createDataFrame([("u", "s", "/w", "m1", None)], "uid string, session_id string, project_path string, model string, git_branch string")
    rows = native.build_rows(msgs, sessions, F.lit("2026-01-01T00:00:00Z"), max_blocks).orderBy("row_no", "part_no").collect()
    parsed = [json.loads(r.row_json) for r in rows]
    assert [p["parentUuid"] for p in parsed] == [None] + [p["uuid"] for p in parsed[:-1]], "every row names the one before"
    assert list(parsed[0]) == ["parentUuid", "isSidechain", "userType", "cwd", "sessionId", "version", "gitBranch", "uuid", "timestamp", "type", "content", "level"]
    assert parsed[0]["content"] == 'be "brief"\n' and parsed[0]["type"] == "system"
    kinds = [p["type"] for p in parsed]
    if max_blocks == 10_000:
        assert kinds == ["system", "user", "assistant", "user", "assistant", "user"]
        assert [b["type"] for b in parsed[2]["message"]["content"]] == ["thinking", "text", "tool_use"]
    else:
        assert kinds == ["system", "user", "assistant", "assistant", "user", "assistant", "assistant", "user"]
        assert parsed[2]["message"]["id"] == parsed[3]["message"]["id"]
    result = next(p for p in parsed if "toolUseResult" in p)
    assert result["message"]["content"][0]["tool_use_id"] == "t9" and result["toolUseResult"] == "out"
    lines = spark.createDataFrame([("f", n + 1, r.row_json) for n, r in enumerate(rows)], "file_path string, line_no long, raw string")
    back = normalize.messages(jsonl.classify(lines)).orderBy("pos").collect()
    expected = [(r, t, x if x is not None or t == "tool_use" else "", n, i) for r, t, x, n, i, _o in TALK if r != "system"]
    assert [(m.role, m.type, m.text, m.tool_name, m.tool_input) for m in back] == expected


def test_snapshot(spark, tmp_path):
    raw = [json.dumps({"type": "user", "uuid": f"u{i}", "message": {"role": "user", "content": f"m{i}"}}) for i in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.jsonl").write_text("\n".join(raw) + "\n")
    (tmp_path / "in" / "bad.jsonl").write_text(raw[0] + "\n{broken\n" + raw[1] + "\n")
    lines = jsonl.read_jsonl(spark, str(tmp_path / "in"))
    states = integrity.integrity_report(lines)
    keyed = lines.withColumn("uid", F.col("file_path"))
    null = F.lit(None).cast("string")
    sessions = states.select(
        F.col("file_path").alias("uid"), "file_path", F.lit(str(tmp_path / "in")).alias("root"), F.lit("s").alias("session_id"), F.lit("t").alias("tool"),
        null.alias("project_path"), null.alias("model"), null.alias("title"), F.lit(1).cast("long").alias("size_bytes"), null.alias("created_at"), null.alias("updated_at"), "integrity")
    messages = normalize.messages(lines).withColumn("uid", F.col("file_path"))
    out = str(tmp_path / "snap")
    manifest = snapshot.export_snapshot(out, sessions, messages, keyed.select("uid", "line_no", "raw"), note="n")
    got = {r.original_relative: r for r in manifest.collect()}
    assert got["good.jsonl"].message_count == 5 and not got["good.jsonl"].has_warning
    assert got["bad.jsonl"].n_lines == 3 and got["bad.jsonl"].has_warning
    assert snapshot.snapshot_warnings(manifest).first().message == "session is damaged"
    hashes = content.content_hash(snapshot.load_normalized(spark, out), ["uid"]).collect()
    assert {h.content_hash for h in hashes} == {r.content_hash for r in got.values()}
    checked = {r.manifest_index: r for r in snapshot.check_restored(manifest, snapshot.load_raw(spark, out), sessions).collect()}
    assert all(checked[r.manifest_index].raw_digest == r.raw_digest for r in got.values())
    newer = str(tmp_path / "newer")
    manifest.withColumn("snapshot_version", F.lit(99)).write.parquet(f"{newer}/manifest")
    with pytest.raises(ValueError):
        snapshot.read_manifest(spark, newer)


def test_audit_is_appended(spark, tmp_path):
    from sessionlake.operators import present

    done = spark.createDataFrame([("copy", "s1", "copied", "/a", "/b"), ("conflict", "s2", "kept-existing", "/c", None)],
                                 "kind string, session_id string, applied string, source_path string, write_path string")
    log = str(tmp_path / "audit")
    store.append_audit(store.audit_rows(done, "sync", F.lit("2026-01-01").cast("timestamp")), log)
    store.append_audit(store.audit_rows(done.limit(1), "sync", F.lit("2026-01-02").cast("timestamp")), log)
    lines = spark.read.text(log).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    events = present.read_audit(lines).collect()
    assert len(events) == 3 and {e.outcome for e in events} == {"copied", "kept-existing"}


def test_files_are_restored_byte_by_byte(spark, tmp_path):
    line = '{"type":"user","uuid":"u%d"}'
    cases = {
        "plain": (line % 1 + "\n" + line % 2 + "\n").encode(), "open": (line % 1 + "\n" + line % 2).encode(),
        "crlf": (line % 1 + "\r\n" + line % 2 + "\r\n").encode(), "crlf-open": (line % 1 + "\r\n" + line % 2).encode(),
        "mark": b"\xef\xbb\xbf" + (line % 1 + "\n" + line % 2 + "\n").encode(), "mark-open": b"\xef\xbb\xbf" + (line % 1 + "\n" + line % 2).encode(),
        "mixed": (line % 1 + "\r\n\n" + line % 2 + "\n{broken\n").encode(),
    }
    (tmp_path / "in").mkdir()
    for name, data in cases.items():
        (tmp_path / "in" / f"{name}.jsonl").write_bytes(data)
    lines = jsonl.read_jsonl(spark, str(tmp_path / "in"))
    stem = F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1)
    keyed = lines.withColumn("uid", stem)
    digests = {r.uid: r.raw_digest for r in snapshot.raw_digests(keyed, ["uid"]).collect()}
    assert len(set(digests.values())) == len(cases), "every difference in bytes shows in the digest"
    paths = keyed.select("uid", F.concat(F.lit("back/"), "uid", F.lit(".jsonl")).alias("rel_path")).distinct()
    written = snapshot.restore_files(keyed, paths, str(tmp_path / "out")).collect()
    assert len(written) == len(cases)
    for name, data in cases.items():
        assert (tmp_path / "out" / "back" / f"{name}.jsonl").read_bytes() == data, name
    with pytest.raises(ValueError):
        snapshot.restore_files(keyed.drop("had_cr"), paths, str(tmp_path / "none"))


def test_native_files_read_back(spark, tmp_path):
    msgs = spark.createDataFrame([("u", i, *m, f"id{i}", None) for i, m in enumerate(TALK)], MESSAGES)
    sessions = spark.createDataFrame([("u", "s", "/w", "m1", None)], "uid string, session_id string, project_path string, model string, git_branch string")
    rows = native.build_rows(msgs, sessions, F.lit("2026-01-01T00:00:00Z"))
    paths = sessions.select("uid", native.suggested_path(F.col("project_path"), F.col("session_id")).alias("rel_path"))
    native.write_native(rows, paths, str(tmp_path / "out"))
    assert (tmp_path / "out" / "projects" / "-w" / "s.jsonl").exists()
    back = normalize.messages(jsonl.read_jsonl(spark, str(tmp_path / "out"))).count()
    assert back == sum(r != "system" for r, *_ in TALK)


def test_half_a_file_is_reported(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a":1}\n{"a":2}\n')
    assert integrity.scan_integrity(spark, str(tmp_path)).first().integrity == "ok"
    whole = jsonl.scan
    monkeypatch.setattr(jsonl, "scan", lambda *a, **k: whole(*a, **k).limit(1))
    assert integrity.scan_integrity(spark, str(tmp_path)).first().integrity == "unreadable"
