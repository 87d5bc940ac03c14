"""Normalisation: split turns, block kinds, unknown rows, identity, comparison."""

import json

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import hashing, text as tx
from sessionlake.operators import compare, content, normalize
from sessionlake.sources import jsonl


def user(i, content, **extra):
    return {"type": "user", "uuid": f"u{i}", "sessionId": "s1", "timestamp": f"2026-01-01T10:00:{i:02d}Z",
            "message": {"role": "user", "content": content}, **extra}


def assistant(i, mid, content, model="m1"):
    return {"type": "assistant", "uuid": f"a{i}", "parentUuid": f"u{i - 1}", "timestamp": f"2026-01-01T10:00:{i:02d}Z",
            "message": {"id": mid, "role": "assistant", "model": model, "content": content}}


THINK = {"type": "thinking", "thinking": "hmm", "signature": "x"}
TEXT = {"type": "text", "text": "answer"}
CALL = {"type": "tool_use", "id": "t1", "name": "Read", "input": {"z": 1, "a": [1, {"y": 2, "b": 3}]}}
RESULT = {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}
IMAGE = {"type": "image", "source": {"type": "base64", "media_type": "image/png"}}
ODD = {"type": "citation", "b": 1, "a": 2}

ROWS = [
    user(1, "hello \r\nworld  "),
    assistant(2, "m1", [THINK]),
    assistant(3, "m1", [TEXT]),
    assistant(4, "m1", [TEXT, CALL]),          # the text block repeats
    user(5, [RESULT, "stray", 7], toolUseResult={"ok": True}),
    user(6, {"type": "tool_result", "tool_use_id": "t2", "content": None}, toolUseResult={"r": 1}),
    assistant(7, "m2", [IMAGE, ODD], model="<synthetic>"),
    assistant(8, "m2", [{"type": "citation", "a": 2, "b": 1}]),   # same block, other key order
    {"type": "ai-title", "aiTitle": "T"},
    {"type": "user", "uuid": "nomsg"},
    {"type": "assistant", "message": {"role": "assistant", "content": "no id"}},
    {"type": "assistant", "message": {"role": "assistant", "content": 5}},
    None, 3, {"x": 1},
]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("m")
    (folder / "s1.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS) + "\n")
    return jsonl.read_jsonl(spark, str(folder))


def test_message_table(spark, lines):
    got = normalize.messages(lines).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(got)))
    seen = [(r.role, r.type, r.text, r.tool_name) for r in got]
    assert seen == [
        ("user", "text", "hello \r\nworld  ", None),
        ("assistant", "thinking", "hmm", None),
        ("assistant", "text", "answer", None),
        ("assistant", "tool_use", None, "Read"),
        ("tool", "tool_result", "one\ntwo", None),
        ("tool", "tool_result", None, None),
        ("assistant", "text", "[image]", None),
        ("assistant", "text", None, "citation"),
        ("assistant", "text", "no id", None),
    ]
    assert got[3].tool_input == '{"a":[1,{"b":3,"y":2}],"z":1}'
    assert got[4].tool_input == '{"tool_use_id":"t1"}'
    assert got[6].tool_output == '{"imageSource":"base64","mediaType":"image/png"}'
    assert got[7].tool_output == '{"a":2,"b":1,"type":"citation"}'
    assert got[8].message_id == "line-11"
    assert got[1].message_id == got[3].message_id == "m1"


def test_raw_rows_counts_and_models(spark, lines):
    parsed = normalize.rows(lines)
    raw = normalize.raw_rows(parsed).orderBy("line_no").collect()
    assert [(r.line_no, r.row_type) for r in raw] == [
        (9, "ai-title"), (10, "user"), (13, "unknown"), (14, "unknown"), (15, "unknown")]
    counts = {r.row_type: r.n_rows for r in normalize.row_type_counts(parsed).collect()}
    assert counts == {"user": 4, "assistant": 7, "ai-title": 1, "unknown": 3}
    seen = normalize.models_seen(parsed)
    assert normalize.dominant_model(seen).first().model == "m1"
    dups = normalize.repeated_blocks(normalize.blocks(parsed))
    assert dups.first().duplicate_blocks == 2


def test_backfill_stays_out_of_the_digest(spark, lines):
    kept = normalize.messages(lines)
    filled = normalize.tool_result_backfill(normalize.rows(lines), kept)
    by_line = {r.line_no: r for r in filled.where("type = 'tool_result'").collect()}
    assert by_line[6].tool_output == '{"r":1}'
    assert by_line[5].tool_output.startswith('[{')
    before = {r.line_no: r.msg_digest for r in kept.where("type = 'tool_result'").collect()}
    assert before == {k: v.msg_digest for k, v in by_line.items()}


def frame(spark, sessions):
    data = [(uid, i, "user" if i % 2 == 0 else "assistant", "text", t, None, None, None)
            for uid, texts in sessions.items() for i, t in enumerate(texts)]
    messages = spark.createDataFrame(
        data, "uid string, pos long, role string, type string, text string, tool_name string, tool_input string, tool_output string")
    return content.with_digest(messages)


CASES = [
    # a, b, relation, common, diverge index, a only, b only, longer, recommendation
    ("abc", "abc", "identical", 3, None, 0, 0, None, "skip"),
    ("abc", "abcde", "prefix", 3, 3, 0, 2, "b", "keep-incoming"),
    ("abcd", "ab", "prefix", 2, 2, 2, 0, "a", "keep-existing"),
    ("xbc", "ybc", "unrelated", 0, 0, 3, 3, None, "keep-both"),
    ("abcd", "abxyz", "diverged", 2, 2, 2, 3, "b", "keep-both"),
    ("abcd", "abcx", "diverged", 3, 3, 1, 1, None, "keep-both"),
    ("", "a", "empty", 0, 0, 0, 1, None, "keep-both"),
    ("", "", "empty", 0, 0, 0, 0, None, "keep-both"),
]


def compared(spark, cases):
    sessions, pairs = {}, []
    for n, (a, b, *_r) in enumerate(cases):
        sessions[f"a{n}"], sessions[f"b{n}"] = list(a), list(b)
        pairs.append((n, f"a{n}", f"b{n}"))
    messages = frame(spark, sessions)
    hashes = content.content_hash(messages, ["uid"])
    facts = spark.createDataFrame([(u,) for u in sessions], "uid string").join(hashes, "uid", "left").withColumn(
        "updated_at", F.when(F.col("uid").startswith("b"), F.lit("2026-01-02").cast("timestamp")))
    table = spark.createDataFrame(pairs, "pair_id long, a_uid string, b_uid string")
    return table, messages, facts, compare.with_recommendation(compare.compare(table, messages, facts))


def test_relations(spark):
    _, _, _, out = compared(spark, CASES)
    got = {r.pair_id: r for r in out.collect()}
    for n, (a, b, relation, common, at, a_only, b_only, longer, advice) in enumerate(CASES):
        r = got[n]
        assert (r.relation, r.common_prefix, r.diverge_index, r.a_only, r.b_only, r.longer, r.recommendation) == (
            relation, common, at, a_only, b_only, longer, advice), (a, b)
        assert r.newer == ("b" if relation != "empty" else None)


def test_union_and_preview(spark):
    pairs, messages, facts, out = compared(spark, CASES)
    merged = content.union_sessions(pairs, messages, out)
    texts = {}
    for r in merged.orderBy("pair_id", "pos").collect():
        texts.setdefault(r.pair_id, []).append(r.text)
    assert "".join(texts[1]) == "abcde" and "".join(texts[2]) == "abcd"
    assert "".join(texts[4]) == "abcdxyz"
    assert [r.pos for r in merged.where("pair_id = 4").orderBy("pos").collect()] == list(range(7))
    hashes = {r.pair_id: r for r in content.union_hashes(merged, facts, pairs).collect()}
    assert hashes[4].merge_kind == "concatenated-branches" and hashes[1].merge_kind == "prefix-extend"
    assert hashes[1].content_hash == hashes[1].b_hash
    preview = compare.diff_preview(out.where("pair_id = 4"), messages).collect()
    assert sorted((r.part, r.pos, r.text) for r in preview) == [
        ("a_next", 2, "c"), ("a_next", 3, "d"), ("b_next", 2, "x"), ("b_next", 3, "y"), ("b_next", 4, "z"),
        ("shared", 0, "a"), ("shared", 1, "b")]


def test_hash_ignores_line_endings_but_not_content(spark):
    messages = frame(spark, {"a": ["hello\nworld", "ok"], "b": ["hello\r\nworld  ", "ok\n"], "c": ["hello world", "ok"]})
    h = {r.uid: r.content_hash for r in content.content_hash(messages, ["uid"]).collect()}
    assert h["a"] == h["b"] != h["c"]
    assert h["a"].startswith("sha256:")


def test_hash_depends_on_order_across_runs(spark):
    n = 9000
    ids = spark.range(n).select(F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("msg_digest"))
    swapped = ids.withColumn("pos", F.when(F.col("pos") == 5, 8000).when(F.col("pos") == 8000, 5).otherwise(F.col("pos")))
    both = ids.withColumn("uid", F.lit("a")).unionByName(swapped.withColumn("uid", F.lit("b"))).unionByName(
        ids.repartition(7).withColumn("uid", F.lit("c")))
    h = {r.uid: r for r in content.content_hash(both, ["uid"]).collect()}
    assert h["a"].content_hash == h["c"].content_hash != h["b"].content_hash
    assert h["a"].message_count == n


def test_validation(spark):
    messages = frame(spark, {"good": ["a"], "bad": ["a"]}).withColumn(
        "role", F.when(F.col("uid") == "bad", "robot").otherwise(F.col("role")))
    hashes = content.content_hash(messages, ["uid"]).select("uid", F.when(F.col("uid") == "bad", "sha256:0").otherwise(F.col("content_hash")).alias("content_hash"))
    header = hashes.select("uid", F.lit(1).alias("schema_version"), F.lit("t").alias("tool"),
                           F.when(F.col("uid") == "bad", "").otherwise("s").alias("session_id"), "content_hash")
    got = sorted((r.uid, r.field) for r in content.validate(header, messages, ["uid"], ("t",)).collect())
    assert got == [("bad", "content_hash"), ("bad", "role"), ("bad", "session_id")]


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.normalize_text(F.lit("  a \t\r\nb\t \n\u00a0")).alias("n"),
        tx.normalize_title(F.lit("Guest/signup -- Feedback!")).alias("t"),
        tx.bare_id(F.lit("local_x")).alias("b"),
        tx.utf16_length(F.lit("a😀é")).alias("u"),
        tx.format_bytes(F.lit(1536)).alias("f"),
        tx.size_warnings(F.lit(100), F.lit("damaged")).alias("w"),
        tx.integrity_rank(F.lit("damaged")).alias("r"), tx.integrity_rank(F.lit("?")).alias("r9"),
        tx.group_label(F.lit("C:\\x\\proj\\")).alias("g"),
        hashing.session_uid(F.lit("t"), F.lit("a"), F.lit("/p")).alias("uid"),
    ).first()
    assert (row.n, row.t, row.b, row.u, row.f, row.w, row.r, row.r9, row.g) == (
        "a\nb", "guest signup feedback", "x", 4, "1.5 KB", ["damaged", "stub"], 3, 9, "proj")
    assert row.uid.startswith("t|a|") and len(row.uid) == 16


def test_natural_order(spark):
    names = ["10. Ruhan", "9. Qun", "Émile 2", "emile 10", "a", "file 007", "File 8"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(tx.natural_key(F.col("n"))).collect()]
    assert got == ["9. Qun", "10. Ruhan", "a", "Émile 2", "emile 10", "file 007", "File 8"]
