"""Numbering rows of groups of any size without sorting a group in one task.

A group is cut into runs of bounded length by a coarse, order-preserving key.
Rows are numbered inside their run; the runs' sizes, one row per run, give
each run its starting number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlake.session import materialize

RUN_LENGTH = 4096


def run_starts(runs: DataFrame, keys: list[str], run: str, amounts: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over the runs of each group (one row per run)."""
    before = W.partitionBy(*keys).orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    return runs.select(
        *keys, run,
        *[F.coalesce(F.sum(amount).over(before), F.lit(0)).alias(out) for amount, out in amounts.items()],
    )


def dense_position(
    frame: DataFrame, keys: list[str], order: list[str], coarse: Column, out: str = "pos"
) -> DataFrame:
    """Adds the 0-based position of each row of its group.

    ``coarse`` maps the first order column to runs, monotonically, with a
    bounded number of rows per run (for example ``line_no div 4096``).
    """
    staged = frame.withColumn("_run", coarse)
    sizes = staged.groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    starts = run_starts(sizes, keys, "_run", {"_n": "_before"})
    inside = W.partitionBy(*keys, "_run").orderBy(*order)
    return (
        staged.withColumn("_inside", F.row_number().over(inside))
        .join(starts, [*keys, "_run"])
        .withColumn(out, F.col("_before") + F.col("_inside") - 1)
        .drop("_run", "_inside", "_before")
    )


def sorted_place(ordered: DataFrame, out: str = "place") -> DataFrame:
    """Adds the 0-based place of each row of a globally sorted frame.

    The sort's partitions follow each other; their sizes, one row each, give
    every partition its first place.  Written once, because places depend on
    how the sort was partitioned.
    """
    marked = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        marked.withColumn("_part", part).join(starts, "_part")
        .withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit(2**33 - 1)))
        .drop("_id", "_part", "_before")
    )


def running_total(
    frame: DataFrame, keys: list[str], position: str, amount: str, out: str
) -> DataFrame:
    """Adds the inclusive running sum of ``amount`` over dense positions."""
    staged = frame.withColumn("_run", F.floor(F.col(position) / RUN_LENGTH))
    sums = staged.groupBy(*keys, "_run").agg(F.sum(amount).alias("_s"))
    starts = run_starts(sums, keys, "_run", {"_s": "_before"})
    inside = (
        W.partitionBy(*keys, "_run").orderBy(position)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        staged.withColumn("_inside", F.sum(amount).over(inside))
        .join(starts, [*keys, "_run"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_run", "_inside", "_before")
    )


def with_previous(frame: DataFrame, keys: list[str], position: str, columns: list[str]) -> DataFrame:
    """Adds ``prev_<column>`` from the row one position earlier.

    Inside a run this is ``lag``; the first row of a run looks the value up in
    a table holding the last row of every run.
    """
    staged = frame.withColumn("_run", F.floor(F.col(position) / RUN_LENGTH))
    last = (
        staged.where(F.col(position) % RUN_LENGTH == RUN_LENGTH - 1)
        .select(*keys, (F.col("_run") + 1).alias("_run"), *[F.col(c).alias(f"_last_{c}") for c in columns])
    )
    inside = W.partitionBy(*keys, "_run").orderBy(position)
    lagged = staged.select("*", *[F.lag(c).over(inside).alias(f"_lag_{c}") for c in columns])
    first = F.col(position) % RUN_LENGTH == 0
    joined = lagged.join(last, [*keys, "_run"], "left")
    for c in columns:
        joined = joined.withColumn(
            f"prev_{c}", F.when(first, F.col(f"_last_{c}")).otherwise(F.col(f"_lag_{c}"))
        )
    return joined.drop("_run", *[f"_last_{c}" for c in columns], *[f"_lag_{c}" for c in columns])
