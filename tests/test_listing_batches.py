"""Many files in a folder, or of a task, are handed on in bounded batches."""

import pandas as pd

from sessionlake.sinks import files
from sessionlake.sources import inventory


def test_entries_of_a_folder_come_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "_ENTRIES", 10)
    for k in range(25):
        (tmp_path / f"{k}.jsonl").write_bytes(b"x" * k)
    frames = list(inventory._listing(False)([pd.DataFrame({"file_path": [f"file://{tmp_path}"]})]))
    assert [len(f) for f in frames] == [10, 10, 5]
    found = pd.concat(frames)
    assert {p.rsplit("/", 1)[1]: n for p, n in zip(found["file_path"], found["size_bytes"])} == {f"{k}.jsonl": k for k in range(25)}


def test_written_files_are_reported_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_BATCH", 3)
    pieces = spark.createDataFrame([(f"d/{k}", n, f"{k}{n}") for k in range(40) for n in range(2)], "rel_path string, n long, value string")
    done = files.write_files(pieces, ["n"], f"file://{tmp_path}/out").collect()
    assert {x.rel_path: x.size_bytes for x in done} == {f"d/{k}": len(f"{k}") * 2 + 2 for k in range(40)}
    assert (tmp_path / "out/d/7").read_bytes() == b"7071"
