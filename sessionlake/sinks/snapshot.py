"""Portable snapshots: manifest, raw lines, normalised messages, sidecars.

A snapshot is a folder of Parquet tables.  Raw lines restore a transcript to
what it was; messages serve comparison.  Sessions of any size are written the
same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.paths import safe_archive_name
from sessionlake.operators import content
from sessionlake.operators.content import message_problems
from sessionlake.sinks.files import write_files

BUCKETS = 64


def raw_digests(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of the bytes of each file, as a tree over its lines like the
    content hash.

    Carriage returns belong to their line; a byte order mark and a last line
    without line feed, where ``lines`` tells them, change the file's digest.
    """
    numbered = lines.select(*keys, (F.col("line_no") - 1).alias("pos"), F.sha2(_as_written(lines), 256).alias("msg_digest"))
    digests = content.content_hash(numbered, keys).select(
        *keys, F.col("content_hash").alias("raw_digest"), F.col("message_count").alias("n_lines"))
    if not _EXACT <= set(lines.columns):
        return digests
    odd = lines.groupBy(*keys).agg(F.bool_or("has_bom").alias("_bom"), F.bool_and("last_line_terminated").alias("_ended"))
    marks = F.concat(F.when(F.col("_bom"), "|bom").otherwise(""), F.when(F.col("_ended"), "").otherwise("|open"))
    marked = F.concat(F.lit("sha256:"), F.sha2(F.concat("raw_digest", marks), 256))
    return digests.join(odd, keys).withColumn(
        "raw_digest", F.when(F.col("_bom") | ~F.col("_ended"), marked).otherwise(F.col("raw_digest"))).drop("_bom", "_ended")


#: What lines have to tell for a file to be restored byte by byte.
_EXACT = {"had_cr", "has_bom", "last_line_terminated", "total_lines"}


def _as_written(lines: DataFrame):
    """The line with its carriage return."""
    return F.concat("raw", F.when(F.col("had_cr"), "\r").otherwise("")) if "had_cr" in lines.columns else F.col("raw")


def restore_files(raw_lines: DataFrame, paths: DataFrame, target: str) -> DataFrame:
    """Writes transcripts back as they were, byte by byte.

    ``raw_lines``: lines of ``read_jsonl`` keyed by ``uid``; ``paths``: ``uid,
    rel_path``.  Files without lines are empty and not in ``raw_lines``.
    Returns ``rel_path, size_bytes, sha256`` of what was written.
    """
    lacking = _EXACT - set(raw_lines.columns)
    if lacking:
        raise ValueError(f"lines do not tell {sorted(lacking)}")
    mark = F.when(F.col("has_bom") & (F.col("line_no") == 1), "\ufeff").otherwise("")
    last_open = (F.col("line_no") == F.col("total_lines")) & ~F.col("last_line_terminated")
    value = F.concat(mark, _as_written(raw_lines), F.when(last_open, "").otherwise("\n"))
    return write_files(raw_lines.join(paths, "uid").select("rel_path", "line_no", value.alias("value")), ["line_no"], target)


def build_manifest(sessions: DataFrame, messages: DataFrame, raw_lines: DataFrame, note: str | None = None) -> DataFrame:
    """One record per session with real digests, counts and integrity.

    ``sessions``: listing columns with ``uid, file_path, root, integrity``;
    damaged sessions are included and flagged; a session without messages or
    lines stays in the manifest as well.
    """
    hashes = content.content_hash(messages, ["uid"])
    raws = raw_digests(raw_lines, ["uid"])
    relative = F.when(
        F.startswith("file_path", F.concat("root", F.lit("/"))), F.expr("substring(file_path, length(root) + 2)")
    ).otherwise(F.element_at(F.split("file_path", "/"), -1))
    joined = sessions.join(hashes, "uid", "left").join(raws, "uid", "left")
    return joined.select(
        F.lit(fv.SNAPSHOT_VERSION).alias("snapshot_version"), F.lit(fv.SCHEMA_VERSION).alias("schema_version"),
        F.lit(note).cast("string").alias("note"),
        F.col("uid").alias("snapshot_uid"), "session_id", "tool", "project_path", "model", "title",
        F.col("file_path").alias("original_path"), relative.alias("original_relative"),
        F.concat(F.lit("raw/"), "tool", F.lit("/"), safe_archive_name(relative)).alias("archive_name"),
        F.coalesce("content_hash", F.concat(F.lit("sha256:"), F.sha2(F.lit(fv.HASH_PREFIX), 256))).alias("content_hash"),
        F.coalesce("message_count", F.lit(0)).alias("message_count"), "raw_digest",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.col("size_bytes").alias("raw_size"),
        "created_at", "updated_at", "integrity",
        F.col("integrity").isin(*fv.UNUSABLE).alias("has_warning"),
    )


def export_snapshot(
    path: str, sessions: DataFrame, messages: DataFrame, raw_lines: DataFrame, sidecars: DataFrame | None = None,
    note: str | None = None,
) -> DataFrame:
    """Writes a snapshot and returns its manifest.

    ``messages`` and ``raw_lines`` are keyed by ``uid``; they are laid out in
    buckets of the uid, so reading one session opens one bucket.
    """
    bucket = F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int").alias("bucket")
    wanted = sessions.select("uid")
    for name, frame in (("messages", messages), ("raw_lines", raw_lines), ("sidecars", sidecars)):
        if frame is not None:
            kept = frame.join(wanted, "uid", "left_semi").select("*", bucket)
            kept.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/{name}")
    # The manifest describes what was written, so it is computed from there.
    read = sessions.sparkSession.read.parquet
    manifest = build_manifest(sessions, read(f"{path}/messages"), read(f"{path}/raw_lines"), note)
    _write_numbered(manifest, f"{path}/manifest")
    return read_manifest(sessions.sparkSession, path)


def _write_numbered(manifest: DataFrame, path: str) -> None:
    """Writes the manifest with a stable position per record."""
    manifest.orderBy("snapshot_uid").withColumn("manifest_index", F.monotonically_increasing_id()).write.mode(
        "errorifexists").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a snapshot; one written by a newer version is refused."""
    manifest = spark.read.parquet(f"{path}/manifest")
    newest = manifest.agg(F.max("snapshot_version")).first()[0]
    if newest is not None and newest > fv.SNAPSHOT_VERSION:
        raise ValueError(f"snapshot format {newest} is newer than {fv.SNAPSHOT_VERSION}")
    return manifest


def load_normalized(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """Messages of a snapshot, of all or the selected ``uid``.

    Messages outside the vocabulary refuse the whole load.
    """
    messages = spark.read.parquet(f"{path}/messages")
    if selected is not None:
        messages = messages.join(selected.select("uid").distinct(), "uid", "left_semi")
    problems = message_problems(messages, ["uid"]).limit(3).collect()
    if problems:
        raise ValueError("snapshot failed validation: " + "; ".join(f"{p.uid} {p.field} at {p.position}" for p in problems))
    return messages.drop("bucket")


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/raw_lines").drop("bucket")


def snapshot_warnings(manifest: DataFrame) -> DataFrame:
    """Sessions exported although damaged: included, flagged, not a source."""
    return manifest.where("has_warning").select(
        "session_id", F.lit("error").alias("level"), F.concat(F.lit("session is "), "integrity").alias("message"))


def check_restored(manifest: DataFrame, raw_lines: DataFrame, integrity: DataFrame) -> DataFrame:
    """Digests recomputed from a snapshot's raw lines, per manifest record, for
    the import to verify before anything is written."""
    digests = raw_digests(raw_lines, ["uid"]).withColumnRenamed("uid", "snapshot_uid")
    states = integrity.select(F.col("uid").alias("snapshot_uid"), F.col("integrity").alias("_state"))
    joined = manifest.select("manifest_index", "snapshot_uid").join(digests, "snapshot_uid", "left").join(states, "snapshot_uid", "left")
    return joined.select("manifest_index", "raw_digest", F.coalesce("_state", F.lit("unreadable")).alias("integrity"))
