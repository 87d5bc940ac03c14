"""Ends of files by seeking, digests by ranges, whole files only, the dedupe window."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import listing, normalize
from sessionlake.sinks.files import write_files
from sessionlake.sources import ends, inventory, jsonl


def listed(spark, folder):
    return inventory.list_transcripts(spark, str(folder))


def row(i, **more):
    return json.dumps({"type": "user", "sessionId": f"s{i % 3}", "timestamp": f"2026-01-01T00:00:{i % 60:02d}Z", "cwd": f"/w/{i}", "message": {"role": "user", "model": f"m{i}"}, **more})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ends")
    place = root / "projects" / "p"
    place.mkdir(parents=True)
    rng = random.Random(4)
    junk = ["", "  ", "{broken", "\t", '{"a":']
    for k in range(25):
        lines = [rng.choice(junk) if rng.random() < 0.3 else row(i) for i in range(rng.choice([0, 1, 5, 60, 400]))]
        if k % 5 == 0 and lines:
            lines[0] = row(0, pad="x" * 300_000)
        if k % 7 == 1:
            lines.append(row(9, pad="é" * 200_000))
        end = "\r\n" if k % 4 == 0 else "\n"
        text = ("﻿" if k % 6 == 0 else "") + end.join(lines) + (end if k % 2 else "")
        (place / f"{k:02d}.jsonl").write_bytes(text.encode())
    return root


def test_ends_are_those_of_a_scan(spark, folder):
    files = listed(spark, folder)
    found = ends.read_ends(files, window_bytes=100_000)
    assert found.where("status <> 'ok'").count() == 0
    lines = jsonl.read_jsonl(spark, str(folder))
    scanned = {(r.file_path, r.line_no): r.raw for r in jsonl.head_rows(lines).collect()}
    assert {(r.file_path, r.line_no): r.raw for r in found.where("part = 'head'").collect()} == scanned
    offsets = jsonl.byte_offsets(jsonl.scan(spark, str(folder)), F.lit(True)).select(
        F.regexp_replace("file_path", "^file:/*", "/").alias("file_path"), "line_no", "byte_offset")
    placed = lines.withColumn("file_path", F.regexp_replace("file_path", "^file:/*", "/")).join(offsets, ["file_path", "line_no"])
    tails = {}
    for r in jsonl.tail_rows(placed, window_bytes=100_000).orderBy("line_no").collect():
        tails.setdefault(r.file_path, []).append(r.raw)
    got = {}
    for r in found.where("part = 'tail'").orderBy("line_no").collect():
        got.setdefault(r.file_path, []).append(r.raw)
    assert got == tails


def test_listing_from_ends_equals_the_sampled_scan(spark, folder):
    files = listed(spark, folder)
    columns = ["file_path", "session_id", "project_path", "model", "created_at", "updated_at", "title"]
    whole = listing.session_meta(jsonl.read_jsonl(spark, str(folder)), files, sampled=True).select(columns)
    ended = listing.sampled_meta(ends.read_ends(files), files).select(columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, ended.collect()))


def test_a_large_file_is_hardly_read(spark, tmp_path):
    place = tmp_path / "projects" / "p"
    place.mkdir(parents=True)
    path = place / "big.jsonl"
    with open(path, "wb") as out:
        out.write(("\n".join(row(i) for i in range(100)) + "\n").encode())
        out.seek(1_600_000_000)
        out.write(("\n" + "\n".join(row(i) for i in range(20)) + "\n").encode())
    got = ends.read_ends(listed(spark, tmp_path))
    assert {r.part: (r.n, r.b < 4_000_000) for r in got.groupBy("part").agg(F.count("*").alias("n"), F.max("bytes_read").alias("b")).collect()} == {
        "head": (40, True), "tail": (8, True)}


def test_files_that_cannot_be_read_are_rows(spark, folder):
    files = listed(spark, folder).select("file_path", "size_bytes").union(spark.createDataFrame([(f"{folder}/projects/p/gone.jsonl", 4)], "f string, s long"))
    assert [r.file_path.rsplit("/")[-1] for r in ends.read_ends(files).where("part = 'error'").collect()] == ["gone.jsonl"]


def test_digests_of_any_size(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "large", "wb") as out:
        out.seek(3_000_000_000)
        out.write(b"end")
    got = {os.path.basename(r.file_path): (r.size_bytes, r.sha256) for r in inventory.file_digests(spark, str(tmp_path)).collect()}
    assert got["small"] == (3, "sha256:" + hashlib.sha256(b"abc").hexdigest()) and got["empty"] == (0, "sha256:" + hashlib.sha256(b"").hexdigest())
    step = inventory.RANGE_BYTES
    zeros, count = hashlib.sha256(bytes(step)).hexdigest(), 3_000_000_000 // step
    last = hashlib.sha256(bytes(3_000_000_000 - count * step) + b"end").hexdigest()
    assert got["large"] == (3_000_000_003, "tree:" + hashlib.sha256((zeros * count + last).encode()).hexdigest())


def test_written_files_are_whole_and_nothing_else_is_left(spark, tmp_path):
    target = str(tmp_path / "out")
    pieces = spark.createDataFrame([(f"d{i % 3}/f{i}", n, f"{i}-{n}\r\n" if n else "") for i in range(9) for n in range(i)] + [("e/none", 0, "")], "rel_path string, n long, value string")
    done = {r.rel_path: (r.size_bytes, r.sha256) for r in write_files(pieces, ["n"], target).collect()}
    for path, (size, digest) in done.items():
        data = open(f"{target}/{path}", "rb").read()
        assert (len(data), "sha256:" + hashlib.sha256(data).hexdigest()) == (size, digest)
    assert len(done) == 9 and sorted(os.listdir(target)) == ["_written", "d0", "d1", "d2", "e"]
    with pytest.raises(Exception, match="not a relative path"):
        write_files(spark.createDataFrame([("../x", 0, "y")], "rel_path string, n long, value string"), ["n"], str(tmp_path / "bad"))


def windowed(rows, window):
    """The reader's way: ids in order of arrival, the oldest forgotten."""
    held, out, file = {}, [], None
    for path, line, block, message, print_ in rows:
        if path != file:
            file, held = path, {}
        if message not in held:
            held[message] = set()
            if len(held) > window:
                del held[next(iter(held))]
        if print_ not in held[message]:
            out.append((path, line, block))
        held[message].add(print_)
    return out


@pytest.mark.parametrize("window", [1, 5, 64])
def test_dedupe_window(spark, window):
    rng = random.Random(window)
    rows = [(f"f{f}", line, block, f"m{rng.randrange(90) if f else line % 70}", f"p{rng.randrange(3)}") for f in range(3) for line in range(1, 700) for block in range(rng.randrange(1, 3))]
    frame = spark.createDataFrame(rows, "file_path string, line_no long, block_no int, message_id string, fingerprint string").repartition(5)
    got = normalize.drop_repeats_in_window(frame, window)
    assert got.columns[:3] == ["file_path", "line_no", "block_no"]
    assert sorted((r.file_path, r.line_no, r.block_no) for r in got.collect()) == sorted(windowed(rows, window))
