"""Inventories of files, from listings only (no content is read).

Spark's file sources drop files without bytes, and an empty transcript is a
finding here, so listings are made by tasks through Arrow file systems.
"""

from __future__ import annotations

import hashlib
import itertools
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.functions.paths import clean_path

# Entries of a folder handed on at a time.
_ENTRIES = 10_000
_ENTRY = "file_path string, is_dir boolean, size_bytes long, mtime_us long"


def _children(folder: str, recursive: bool) -> Iterator[tuple]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(path)] if "://" in folder and not folder.startswith("file:") else ""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(path, recursive=recursive))
    else:
        found = []
    for entry in found:
        is_dir = entry.type == fs.FileType.Directory
        yield scheme + entry.path, is_dir, None if is_dir else entry.size, entry.mtime_ns // 1000


def _listing(recursive: bool):
    columns = ["file_path", "is_dir", "size_bytes", "mtime_us"]

    def run(batches):
        for batch in batches:
            for folder in batch["file_path"]:
                found = _children(folder, recursive)
                while rows := list(itertools.islice(found, _ENTRIES)):
                    frame = pd.DataFrame(rows, columns=columns)
                    yield frame.astype({"size_bytes": "Int64"})

    return run


def list_entries(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """Files and folders below the roots: ``file_path, is_dir, size_bytes, mtime_us``.

    The first two levels are expanded folder by folder and spread over the
    cluster; what lies below is listed by the task that holds the folder.
    """
    wanted = [roots] if isinstance(roots, str) else list(roots)
    level = spark.createDataFrame([(r.rstrip("/"),) for r in wanted], "file_path string")
    seen = None
    for _ in range(2):
        level = level.mapInPandas(_listing(False), _ENTRY)
        files = level
        seen = files if seen is None else seen.unionByName(files)
        level = level.where("is_dir").select("file_path").repartition("file_path")
    return seen.unionByName(level.mapInPandas(_listing(True), _ENTRY))


def list_files(spark: SparkSession, roots: str | list[str], glob: str = "*") -> DataFrame:
    """``file_path, size_bytes, mtime`` of all files below the roots, empty ones too."""
    pattern = glob.replace(".", r"\.").replace("*", "[^/]*")
    return (
        list_entries(spark, roots)
        .where(~F.col("is_dir") & F.col("file_path").rlike(f"/{pattern}$"))
        .select("file_path", "size_bytes", F.timestamp_micros("mtime_us").alias("mtime"))
    )


def classify_paths(files: DataFrame) -> DataFrame:
    """Transcript files by their place below ``<root>/projects``.

    Main transcripts sit directly in a project folder; agent transcripts and
    journals sit below the folder of their parent session.
    """
    main = r"^(.*)/projects/([^/]+)/([^/]+)\.jsonl$"
    child = r"^(.*)/projects/([^/]+)/([^/]+)/subagents/workflows/([^/]+)/([^/]+)\.jsonl$"
    path = F.col("file_path")
    is_child, is_main = path.rlike(child), path.rlike(main)
    part = lambda pattern, n: F.regexp_extract(path, pattern, n)
    return files.where(is_child | is_main).select(
        "file_path",
        F.when(is_child, part(child, 1)).otherwise(part(main, 1)).alias("root"),
        F.when(is_child, part(child, 2)).otherwise(part(main, 2)).alias("project_dir"),
        F.when(is_child, part(child, 5)).otherwise(part(main, 3)).alias("file_session_id"),
        F.when(~is_child, "main")
        .when(part(child, 5) == "journal", "journal")
        .otherwise("agent")
        .alias("kind"),
        F.when(is_child, part(child, 3)).alias("parent_session_id"),
        F.when(is_child, part(child, 4)).alias("workflow_id"),
        "size_bytes", "mtime",
    )


def list_transcripts(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """All transcripts under the roots, with kind and parent."""
    return classify_paths(list_files(spark, roots, "*.jsonl"))


def classify_sidecars(files: DataFrame) -> DataFrame:
    """Sidecar files: todo lists, and files of a session's history folder."""
    path = F.col("file_path")
    todo = r"^(.*)/todos/([^/]+)$"
    history = r"^(.*)/file-history/([^/]+)/.+$"
    is_todo, is_history = path.rlike(todo), path.rlike(history)
    return files.where(is_todo | is_history).select(
        "file_path",
        F.when(is_todo, "todo").otherwise("file-history").alias("kind"),
        F.when(is_todo, F.regexp_extract(path, todo, 1))
        .otherwise(F.regexp_extract(path, history, 1)).alias("root"),
        F.when(is_todo, F.regexp_extract(path, todo, 2))
        .otherwise(F.regexp_extract(path, history, 2)).alias("owner_name"),
        "size_bytes",
    )


def attach_sidecars(sidecars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sidecars of each session (``root``, ``session_id``).

    A todo list belongs to every session its name starts with.  Both kinds are
    equi-joins: a name is compared through its prefixes of the lengths session
    ids have, which are few (ids are UUIDs, and a file name has a bounded
    length anyway).
    """
    lengths = sessions.select(F.length("session_id").alias("_length")).distinct()
    ids = sessions.select("root", "session_id").distinct()
    names = sidecars.where("kind = 'todo'").select(
        "*", F.explode(F.sequence(F.lit(1), F.length("owner_name"))).alias("_length")
    )
    prefixed = names.join(lengths, "_length", "left_semi").select(
        "root", F.substring("owner_name", F.lit(1), F.col("_length")).alias("session_id"),
        "kind", "file_path", "size_bytes",
    )
    exact = sidecars.where("kind = 'file-history'").select(
        "root", F.col("owner_name").alias("session_id"), "kind", "file_path", "size_bytes"
    )
    return prefixed.unionByName(exact).join(ids, ["root", "session_id"])


# Bytes of a range that a task digests, and that it holds at once.
RANGE_BYTES = 64 * 1024 * 1024
_BLOCK_BYTES = 4 * 1024 * 1024


def _digest_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path, start, end in zip(batch["file_path"], batch["start"], batch["end"]):
            system, place = fs.FileSystem.from_uri(path)
            digest, left = hashlib.sha256(), end - start
            with system.open_input_file(place) as source:
                source.seek(start)
                while left:
                    block = source.read(min(left, _BLOCK_BYTES))
                    if not block:
                        raise OSError(f"{path} is shorter than it was listed")
                    digest.update(block)
                    left -= len(block)
            digests.append(digest.hexdigest())
        yield batch.assign(digest=digests)


def file_digests(spark: SparkSession, roots: str | list[str], glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file_path, size_bytes, sha256`` of files of any size.

    A file is digested in ranges of ``range_bytes``, spread over tasks that hold
    a few megabytes each.  The digest of a file of one range is that of its
    bytes; that of a longer one is the digest of its ranges' digests in order,
    ``tree:`` instead of ``sha256:``.
    """
    files = list_files(spark, roots, glob).select("file_path", "size_bytes")
    step = F.lit(range_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)), step)
    ranges = files.select("file_path", "size_bytes", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + step, F.col("size_bytes"))).repartition("file_path", "start")
    found = ranges.mapInPandas(_digest_ranges, "file_path string, size_bytes long, start long, end long, digest string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"])
    return found.groupBy("file_path", "size_bytes").agg(ordered.alias("_d")).select(
        "file_path", "size_bytes",
        F.when(F.size("_d") == 1, F.concat(F.lit("sha256:"), F.col("_d")[0]))
        .otherwise(F.concat(F.lit("tree:"), F.sha2(F.array_join("_d", ""), 256))).alias("sha256"))
