"""Folder names of long paths."""

import random

from pyspark.sql import functions as F

from sessionlake.functions import paths


def plain_hash(path):
    h, raw = 0, path.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[k:k + 2], "big")) & 0xFFFFFFFF
    h, out = abs(h - (1 << 32) if h >= 1 << 31 else h), ""
    while h:
        h, digit = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
    return out or "0"


def test_long_paths_are_hashed_in_one_pass(spark):
    rng = random.Random(3)
    texts = ["", "a", "/w/\U0001F600", "polygenelubricants", *["".join(rng.choices("ab/é\U0001F600\x00 z", k=n)) for n in (3, 199, 201, 70_000)]]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "path string")
    hashed = frame.select("path", paths.path_hash(F.col("path")).alias("h"), paths.encode_project_dir(F.col("path")).alias("d"))
    for path, h, name in hashed.collect():
        if path is None:
            assert (h, name) == (None, "")
            continue
        assert h == plain_hash(path)
        assert not len(name) > 200 or name.endswith("-" + plain_hash(path))
    # No expression per character is left in the plan.
    assert "aggregate(" not in hashed._jdf.queryExecution().optimizedPlan().toString()
