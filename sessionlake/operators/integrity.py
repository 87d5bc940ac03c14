"""Integrity reports: what is damaged, where, and how badly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.jsonvalues import parse_lines
from sessionlake.functions.paths import clean_path
from sessionlake.functions.text import js_trim, size_warnings
from sessionlake.sources import jsonl

ERROR_STATES = ("parse", "truncated-tail", "oversized-line")


def integrity_class(content_lines: Column, errors: Column, tail_errors: Column) -> Column:
    """Class of a file from its counts of non-blank lines, errors and tail errors."""
    return (
        F.when(content_lines == 0, "empty")
        .when(errors == 0, "ok")
        .when((errors == 1) & (tail_errors == 1), "truncated")
        .otherwise("damaged")
    )


def integrity_report(lines: DataFrame) -> DataFrame:
    """One row per file from classified lines; every line is in one counter."""
    counts = lines.groupBy("file_path").agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("status") == "ok").alias("parsed_rows"),
        F.count_if(F.col("status") == "blank").alias("blank_lines"),
        F.count_if(F.col("status").isin(*ERROR_STATES)).alias("error_count"),
        F.count_if(F.col("status") == "truncated-tail").alias("_tail"),
    )
    content = F.col("total_lines") - F.col("blank_lines")
    return counts.withColumn(
        "integrity", integrity_class(content, F.col("error_count"), F.col("_tail"))
    ).drop("_tail")


def error_list(lines: DataFrame, limit: int = fv.ERRORS_KEPT) -> DataFrame:
    """First ``limit`` bad lines of each file with a clipped sample.

    The report's error count is not limited, only this listing is.
    """
    text = js_trim(F.col("raw"))
    sample = F.when(
        F.length(text) > 160, F.concat(F.substring(text, 1, 80), F.lit(" ... "), F.right(text, F.lit(40)))
    ).otherwise(text)
    order = W.partitionBy("file_path").orderBy("line_no")
    offset = ["byte_offset"] if "byte_offset" in lines.columns else []
    return (
        lines.where(F.col("status").isin(*ERROR_STATES))
        .select("file_path", "line_no", *offset, F.col("status").alias("kind"), sample.alias("sample"))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= limit)
        .drop("_n")
    )


def scan_integrity(spark: SparkSession, paths: str | list[str], inventory: DataFrame | None = None) -> DataFrame:
    """Full-file verification in one pass over the bytes.

    No line numbers are needed: the last line of a file is the last one of its
    last split.  Lines are counted per split first, with plain numbers, so the
    counting is hash-based and complete before the shuffle.  ``inventory`` (see
    ``sources.inventory``) adds the files that yield no lines: empty ones, and
    ``unreadable`` ones.
    """
    flagged = parse_lines(jsonl.scan(spark, paths, tolerant=True), with_row=False)
    bad = F.col("status").isin("parse", "oversized-line")
    per_split = flagged.groupBy("file_path", "split_start").agg(
        F.max("file_size").alias("size_bytes"), F.sum("line_bytes").alias("_bytes"),
        F.count("*").alias("_lines"),
        F.count_if(F.col("status") == "ok").alias("_ok"),
        F.count_if(F.col("status") == "blank").alias("_blank"),
        F.count_if(bad).alias("_bad"),
        F.max("scan_order").alias("_last"), F.max(F.when(bad, F.col("scan_order"))).alias("_last_bad"),
    )
    ends_badly = F.col("_last").eqNullSafe(F.col("_last_bad"))
    counts = per_split.groupBy("file_path").agg(
        F.max("size_bytes").alias("size_bytes"),
        F.sum("_lines").alias("total_lines"), F.sum("_ok").alias("parsed_rows"),
        F.sum("_blank").alias("blank_lines"), F.sum("_bad").alias("error_count"),
        F.max(F.struct("split_start", ends_badly.alias("bad"))).alias("_last"),
        (F.max("size_bytes") - F.sum("_bytes")).alias("_rest"),
    )
    terminated = ~F.col("_rest").isin(-1, 2)
    tail = (F.col("_last.bad") & ~terminated).cast("int")
    content = F.col("total_lines") - F.col("blank_lines")
    # A byte order mark is 3 bytes, a missing last line feed is 1 less; any
    # other difference means that part of the file was not read.
    whole = F.col("_rest").isin(-1, 0, 2, 3)
    state = F.when(whole, integrity_class(content, F.col("error_count"), tail)).otherwise("unreadable")
    report = counts.select(
        clean_path(F.col("file_path")).alias("file_path"),
        "size_bytes", "total_lines", "parsed_rows", "blank_lines", "error_count",
        terminated.alias("last_line_terminated"),
        state.alias("integrity"),
    )
    return report if inventory is None else with_inventory(report, inventory)


def with_inventory(report: DataFrame, inventory: DataFrame) -> DataFrame:
    """Report for every listed file: those without lines are empty when they
    have no bytes, and unreadable otherwise."""
    listed = inventory.select("file_path", F.col("size_bytes").alias("_listed"))
    joined = listed.join(report.drop("size_bytes"), "file_path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        "file_path", F.col("_listed").alias("size_bytes"),
        zero("total_lines"), zero("parsed_rows"), zero("blank_lines"),
        F.coalesce("error_count", F.when(F.col("_listed") > 0, 1).otherwise(0)).cast("long").alias("error_count"),
        F.coalesce("last_line_terminated", F.lit(True)).alias("last_line_terminated"),
        F.coalesce("integrity", F.when(F.col("_listed") > 0, "unreadable").otherwise("empty")).alias("integrity"),
    )


def verify(spark: SparkSession, paths, inventory: DataFrame | None = None) -> DataFrame:
    """Deep verification: the report plus warning codes."""
    report = scan_integrity(spark, paths, inventory)
    return report.withColumn("warnings", size_warnings(F.col("size_bytes"), F.col("integrity")))
