"""Files with exactly given bytes, written by tasks.

Spark's text writer names its own part files and always ends lines with a line
feed.  Where a file has to have its own name and its exact bytes, the lines of
a file meet in one task in order and are streamed out: a byte stream is
sequential, but its size is not bounded by memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

_PARTIAL = "_partial"
# Finished files reported at a time.
_BATCH = 10_000
_WRITTEN = "rel_path string, size_bytes long, sha256 string"


def _safe(rel_path: str) -> str:
    parts = rel_path.split("/")
    if rel_path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a relative path: {rel_path!r}")
    return rel_path


def write_files(pieces: DataFrame, order: list[str], target: str) -> DataFrame:
    """Writes ``pieces`` (``rel_path``, ``value`` with its own line ends, and the
    ``order`` columns) below ``target``, one file per ``rel_path``.

    Every attempt writes to a name of its own and renames the finished file, so
    a file that is there is whole; what killed attempts left is removed at the
    end.  Returns what was written: ``rel_path, size_bytes, sha256``, kept in
    ``<target>/_written``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(target)
        name, stream, digest, size, done = None, None, None, 0, []
        own = f"{root}/{_PARTIAL}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)

        def finished():
            if name is not None:
                stream.close()
                path = f"{root}/{_safe(name)}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                system.move(f"{own}/file", path)
                done.append((name, size, "sha256:" + digest.hexdigest()))

        for batch in batches:
            for rel_path, value in zip(batch["rel_path"], batch["value"]):
                if rel_path != name:
                    finished()
                    if len(done) >= _BATCH:
                        yield pd.DataFrame(done, columns=["rel_path", "size_bytes", "sha256"])
                        done.clear()
                    name, digest, size = rel_path, hashlib.sha256(), 0
                    _safe(rel_path)
                    stream = system.open_output_stream(f"{own}/file")
                data = value.encode("utf-8", "surrogatepass")
                stream.write(data)
                digest.update(data)
                size += len(data)
        finished()
        yield pd.DataFrame(done, columns=["rel_path", "size_bytes", "sha256"])

    ordered = pieces.repartition("rel_path").sortWithinPartitions("rel_path", *order).select("rel_path", "value")
    ordered.mapInPandas(run, _WRITTEN).write.mode("errorifexists").parquet(f"{target}/_written")
    system, root = fs.FileSystem.from_uri(target)
    if system.get_file_info(f"{root}/{_PARTIAL}").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/{_PARTIAL}")
    return pieces.sparkSession.read.parquet(f"{target}/_written")
