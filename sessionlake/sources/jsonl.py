"""Lossless JSONL scan: every physical line, numbered, none skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.jsonvalues import parse_lines
from sessionlake.functions.paths import clean_path
from sessionlake.operators.positions import run_starts
from sessionlake.session import configure, estimated_bytes, shared

# The table of splits is broadcast only while it is provably small: one row of
# at most about 300 bytes per split.
_BROADCAST_SPLITS = 200_000


def scan(spark: SparkSession, paths: str | list[str], tolerant: bool = False) -> DataFrame:
    """Physical lines of JSONL files, split on line feeds only.

    A read error fails the job, so that no half of a file passes for the whole.
    ``tolerant`` leaves out what can't be read instead; verification does so
    and reports files whose bytes do not add up.

    One row per line: ``file_path``, ``file_size``, ``split_start``,
    ``scan_order`` (increasing inside a split), ``raw`` without the line feed
    and one trailing carriage return (``had_cr``), ``line_bytes`` including both.  Empty
    files give no rows; the inventory knows them.
    """
    configure(spark)
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .option("ignoreMissingFiles", str(tolerant).lower())
        .option("ignoreCorruptFiles", str(tolerant).lower())
        .text(paths)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("scan_order"),
        (F.octet_length("value") + 1).cast("long").alias("line_bytes"),
        _without_cr(F.col("value")).alias("raw"),
        F.endswith("value", F.lit("\r")).alias("had_cr"),
    )


def _without_cr(value: Column) -> Column:
    return F.when(
        F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)
    ).otherwise(value)


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: where its lines start, and totals of its file.

    The bytes the lines account for differ from the file size by one when the
    last line has no line feed, and by three when there is a byte order mark.
    """
    # Used three times below, and each use would scan the files again.
    sizes = shared(lines.groupBy("file_path", "split_start").agg(
        F.min("scan_order").alias("_first"),
        F.count("*").alias("_lines"),
        F.sum("line_bytes").alias("_bytes"),
        F.max("file_size").alias("_size"),
    ), "splits")
    starts = run_starts(
        sizes, ["file_path"], "split_start", {"_lines": "_lines_before", "_bytes": "_bytes_before"}
    )
    whole = sizes.groupBy("file_path").agg(
        F.sum("_lines").alias("total_lines"),
        (F.max("_size") - F.sum("_bytes")).alias("_rest"),
    )
    return (
        sizes.join(starts, ["file_path", "split_start"])
        .join(whole, "file_path")
        .select(
            "file_path", "split_start", "_first", "_lines_before", "_bytes_before", "total_lines",
            (~F.col("_rest").isin(-1, 2)).alias("last_line_terminated"),
            F.when(F.col("_rest") >= 2, 3).otherwise(0).alias("_mark_bytes"),
        )
    )


def _join_splits(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines with their split; the text is not shuffled while the split table
    is known to be small, and meets it in a sort-merge join beyond that."""
    spark = lines.sparkSession
    split_bytes = _bytes_setting(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    bound = estimated_bytes(lines) // split_bytes + len(lines.inputFiles())
    side = F.broadcast(splits) if bound <= _BROADCAST_SPLITS else splits
    # Splits are counted when the plan is built.  If files or split settings
    # change before it runs, it fails instead of losing or misnumbering lines.
    changed = F.raise_error(F.concat(F.lit("splits changed since they were counted: "), "file_path"))
    lost = F.col("_first").isNull() | (F.col("scan_order") < F.col("_first"))
    # Tested in the first operand of the line number: arithmetic stops at a null.
    return lines.join(side, ["file_path", "split_start"], "left").withColumn(
        "_lines_before", F.when(lost, changed).otherwise(F.col("_lines_before"))
    )


def _bytes_setting(value: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = value.strip().lower().removesuffix("b") or "0"
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds exact 1-based ``line_no``, and of the file ``total_lines``,
    ``last_line_terminated`` and ``has_bom``.

    Rows of a split are contiguous and in order in the scan, so a line's number
    is its distance from the split's first row plus the lines of earlier splits.
    """
    return (
        _join_splits(lines, _splits(lines))
        .withColumn("line_no", F.col("_lines_before") + F.col("scan_order") - F.col("_first") + 1)
        .withColumn("has_bom", F.col("_mark_bytes") > 0)
        .drop("_first", "_lines_before", "_bytes_before", "_mark_bytes")
    )


def byte_offsets(lines: DataFrame, wanted: Column) -> DataFrame:
    """``line_no`` and true ``byte_offset`` of the lines selected by ``wanted``.

    Only lengths travel in the shuffle; the text is kept for selected lines.
    """
    narrow = lines.select(
        "file_path", "split_start", "scan_order", "line_bytes",
        wanted.alias("_wanted"), F.when(wanted, F.col("raw")).alias("raw"),
    )
    inside = (
        W.partitionBy("file_path", "split_start").orderBy("scan_order")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    summed = narrow.withColumn("_inside", F.coalesce(F.sum("line_bytes").over(inside), F.lit(0)))
    return _join_splits(summed.where("_wanted"), _splits(lines)).select(
        "file_path",
        (F.col("_lines_before") + F.col("scan_order") - F.col("_first") + 1).alias("line_no"),
        (F.col("_mark_bytes") + F.col("_bytes_before") + F.col("_inside")).alias("byte_offset"),
        "raw", "total_lines", "last_line_terminated",
    )


def classify(lines: DataFrame) -> DataFrame:
    """Adds ``status`` and the parsed ``row`` of each line.

    A failed last line of a file without a final line feed is a
    ``truncated-tail``: its writer may have stopped in the middle.
    """
    gated = parse_lines(lines)
    if {"line_no", "total_lines", "last_line_terminated"} <= set(lines.columns):
        tail = (F.col("line_no") == F.col("total_lines")) & ~F.col("last_line_terminated")
        failed = F.col("status").isin("parse", "oversized-line")
        gated = gated.withColumn("status", F.when(failed & tail, "truncated-tail").otherwise(F.col("status")))
    return gated


def read_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Numbered, classified lines of the JSONL files under ``paths``."""
    lines = classify(number_lines(scan(spark, paths)))
    return lines.withColumn("file_path", clean_path(F.col("file_path")))


def head_rows(lines: DataFrame, limit: int = fv.HEAD_ROWS) -> DataFrame:
    """First ``limit`` parseable rows of every file (top-k, cut before the shuffle)."""
    order = W.partitionBy("file_path").orderBy("line_no")
    return (
        lines.where("status = 'ok'")
        .withColumn("head_no", F.row_number().over(order))
        .where(F.col("head_no") <= limit)
    )


def tail_rows(
    lines: DataFrame, limit: int = fv.TAIL_ROWS, window_bytes: int | None = fv.TAIL_SCAN_BYTES
) -> DataFrame:
    """Last ``limit`` parseable rows of every file.

    With byte offsets present only lines that start in the last
    ``window_bytes`` count, as in a reader that seeks from the end.
    """
    kept = lines.where("status = 'ok'")
    if window_bytes is not None and "byte_offset" in lines.columns:
        # A line starting exactly at the cut is dropped too: a seeking reader
        # cannot tell it from the end of a longer one.
        start = F.col("file_size") - window_bytes
        kept = kept.where((start <= 0) | (F.col("byte_offset") > start))
    order = W.partitionBy("file_path").orderBy(F.desc("line_no"))
    return kept.withColumn("tail_no", F.row_number().over(order)).where(F.col("tail_no") <= limit)
