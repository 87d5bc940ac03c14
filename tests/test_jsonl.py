"""Damage is classified and counted; undamaged rows are always recovered."""

import json

import pytest

from pyspark.sql import functions as F

from sessionlake.functions.jsonvalues import parse_lines
from sessionlake.operators import integrity, normalize
from sessionlake.sources import inventory, jsonl


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


ROW = json.dumps({"type": "user", "n": 1})

CASES = {
    "ok": (f"{ROW}\n{ROW}\n", "ok", 2, 2, 0, 0),
    "unterminated_but_valid": (f"{ROW}\n{ROW}", "ok", 2, 2, 0, 0),
    "truncated": (f"{ROW}\n{ROW[:9]}", "truncated", 2, 1, 0, 1),
    "bad_terminated_tail": (f"{ROW}\n{ROW[:9]}\n", "damaged", 2, 1, 0, 1),
    "interior": (f"{ROW}\n{{broken\n{ROW}\n", "damaged", 3, 2, 0, 1),
    "interior_and_tail": (f"{{x\n{ROW}\n{{y", "damaged", 3, 1, 0, 2),
    "split_record": ('{"a":"b\nc"}\n' + ROW + "\n", "damaged", 3, 1, 0, 2),
    "crlf": (f"{ROW}\r\n\r\n{ROW}\r\n", "ok", 3, 2, 1, 0),
    "bom": ("﻿" + f"{ROW}\n", "ok", 1, 1, 0, 0),
    "bom_truncated": ("﻿" + f"{ROW}\n{{", "truncated", 2, 1, 0, 1),
    "blank_only": (" \n\t\n \n", "empty", 3, 0, 3, 0),
    "empty": ("", "empty", 0, 0, 0, 0),
    "scalars": ('1\n"x"\nnull\ntrue\n[1]\n', "ok", 5, 5, 0, 0),
    "junk_after": (ROW + " junk\n" + ROW + "\n", "damaged", 2, 1, 0, 1),
    "two_values": (ROW + "," + ROW + "\n" + ROW + "\n", "damaged", 2, 1, 0, 1),
    "duplicate_keys": ('{"a":1,"a":2}\n', "ok", 1, 1, 0, 0),
    "lenient_syntax": ("{'a':1}\nNaN\n{\"a\":1,}\n", "damaged", 3, 0, 0, 3),
    "marker_inside": ('{"a":"~end-of-row~"}\n1,"~end-of-row~"],[\n', "damaged", 2, 1, 0, 1),
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, (text, *_rest) in CASES.items():
        write(folder, f"projects/p/{name}.jsonl", text)
    return folder


def by_name(rows):
    return {r["file_path"].rsplit("/", 1)[1].removesuffix(".jsonl"): r for r in rows}


def test_every_damage_class(spark, corpus):
    listed = inventory.list_transcripts(spark, str(corpus))
    got = by_name(integrity.verify(spark, str(corpus), listed).collect())
    assert set(got) == set(CASES)
    for name, (text, cls, total, ok, blank, errors) in CASES.items():
        r = got[name]
        assert (r.integrity, r.total_lines, r.parsed_rows, r.blank_lines, r.error_count) == (
            cls, total, ok, blank, errors), name
        assert r.parsed_rows + r.blank_lines + r.error_count == r.total_lines
        assert r.size_bytes == len(text.encode())


def test_numbered_report_agrees_with_the_one_pass_scan(spark, corpus):
    numbered = by_name(integrity.integrity_report(jsonl.read_jsonl(spark, str(corpus))).collect())
    scanned = by_name(integrity.scan_integrity(spark, str(corpus)).collect())
    assert set(numbered) == set(scanned)
    for name, r in numbered.items():
        assert r.integrity == scanned[name].integrity, name
        assert r.error_count == scanned[name].error_count


def test_line_numbers_and_offsets_over_many_splits(spark, tmp_path):
    lines = [json.dumps({"n": i, "t": "é" * (i % 37)}, ensure_ascii=False) for i in range(4000)]
    lines[2500] = "{broken"
    data = ("﻿" + "\n".join(lines)).encode()
    path = write(tmp_path, "big.jsonl", data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        numbered = jsonl.number_lines(jsonl.scan(spark, path))
        rows = numbered.select("line_no", "raw", "total_lines", "last_line_terminated").collect()
        assert len({r.line_no for r in rows}) == 4000
        assert all(lines[r.line_no - 1] == r.raw for r in rows)
        assert {(r.total_lines, r.last_line_terminated) for r in rows} == {(4000, False)}
        found = jsonl.byte_offsets(jsonl.scan(spark, path), F.col("raw") == "{broken").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_no for r in found] == [2501]
    assert data[found[0].byte_offset:][:7] == b"{broken"


def test_error_list_is_bounded_but_the_count_is_not(spark, tmp_path):
    write(tmp_path, "shredded.jsonl", "".join(f"{{bad {i}\n" for i in range(900)) + ROW + "\n")
    lines = jsonl.read_jsonl(spark, str(tmp_path))
    assert integrity.integrity_report(lines).first().error_count == 900
    errors = integrity.error_list(lines).collect()
    assert sorted(r.line_no for r in errors) == list(range(1, 201))


def test_head_and_tail_rows(spark, tmp_path):
    body = ["{bad"] + [json.dumps({"n": i}) for i in range(100)] + ["", "{junk"]
    write(tmp_path, "a.jsonl", "\n".join(body))
    lines = jsonl.read_jsonl(spark, str(tmp_path))
    assert sorted(r.line_no for r in jsonl.head_rows(lines, 3).collect()) == [2, 3, 4]
    assert sorted(r.line_no for r in jsonl.tail_rows(lines, 2).collect()) == [100, 101]


def test_lines_beyond_the_parsers_own_limits_are_rows(spark, tmp_path):
    """Strings of 21 million characters and numbers of 1 500 digits."""
    text, number = "x" * 21_000_000, "7" * 1500
    row = '{"type":"user","uuid":"u%d","message":{"role":"user","content":%s}}'
    block = '[{"type":"tool_use","name":"n","input":{"v":%s}},{"type":"text","text":"after"}]'
    write(tmp_path, "long.jsonl", "\n".join([
        row % (1, f'"{text}"'), row % (2, block % number), f'{{"a":"{text}', f'{{"a":{number}', ROW, row % (3, f'"{text}~end-of-row~"')]) + "\n")
    lines = jsonl.read_jsonl(spark, str(tmp_path))
    assert [r.status for r in lines.orderBy("line_no").select("status").collect()] == ["ok", "ok", "parse", "parse", "ok", "ok"]
    found = normalize.messages(lines).select(
        "line_no", "type", F.length("text").alias("n"), "tool_name", F.length("msg_digest").alias("d")).orderBy("pos").collect()
    assert [(r.line_no, r.type, r.n, r.tool_name, r.d) for r in found] == [
        (1, "text", 21_000_000, None, 64), (2, "tool_use", None, "n", 64), (2, "text", 5, None, 64), (6, "text", 21_000_012, None, 64)]
    report = integrity.verify(spark, str(tmp_path)).first()
    assert (report.parsed_rows, report.error_count) == (4, 2)


def test_no_leniency_beyond_the_limits(spark):
    """What the second parse is more tolerant of by default stays refused."""
    number = "7" * 1500
    bad = [f"{{'a':{number}}}", f'{{"a":[NaN,{number}]}}', f'{{"a":{number},}}', f'{{"a":{number}}} {{}}', f'{{"a":{number}}},{{"b":1}}', f'{{"a":0{number}}}']
    frame = spark.createDataFrame([(t,) for t in [*bad, f'{{"a":-{number}.5e3}}']], "raw string")
    got = {r.raw: r.status for r in parse_lines(frame).collect()}
    assert [got[t] for t in bad] == ["parse"] * len(bad) and list(got.values()).count("ok") == 1


def test_changed_splits_fail_instead_of_losing_lines(spark, tmp_path):
    write(tmp_path, "a.jsonl", (ROW + "\n") * 500)
    numbered = jsonl.number_lines(jsonl.scan(spark, str(tmp_path)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        with pytest.raises(Exception, match="splits changed"):
            numbered.agg({"line_no": "max"}).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
