"""Plans as reviewable tables, the audit trail, and backups of replaced rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AUDIT_COLUMNS = (
    "at", "action", "session_id", "kind", "outcome", "source_path", "dest_path", "backup_path", "resolution", "error",
)


def save_plan(actions: DataFrame, path: str, plan_id: str) -> DataFrame:
    """Writes a plan once and reads it back: what was reviewed is what is applied."""
    target = f"{path.rstrip('/')}/plan_id={plan_id}"
    actions.write.mode("errorifexists").parquet(target)
    return load_plan(actions.sparkSession, path, plan_id)


def load_plan(spark: SparkSession, path: str, plan_id: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/plan_id={plan_id}")


def summarize_plan(actions: DataFrame, target: str | None = None) -> DataFrame:
    """Actions per kind; with ``target`` also the distinct targets of each kind."""
    if target is None:
        return actions.groupBy("kind").agg(F.count("*").alias("n_actions"))
    per_target = actions.groupBy("kind", target).agg(F.count("*").alias("_n"))
    return per_target.groupBy("kind").agg(
        F.sum("_n").alias("n_actions"), F.count(target).alias("n_targets")
    )


def summarize_results(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("applied").agg(F.count("*").alias("n_actions"))


def audit_rows(outcomes: DataFrame, action: str, at: Column | None = None) -> DataFrame:
    """Audit events of applied actions."""
    text = lambda c: (F.col(c) if c in outcomes.columns else F.lit(None)).cast("string")
    return outcomes.select(
        (F.current_timestamp() if at is None else at).alias("at"),
        F.lit(action).alias("action"), text("session_id").alias("session_id"), text("kind").alias("kind"),
        F.col("applied").alias("outcome"), text("source_path").alias("source_path"),
        F.coalesce(text("write_path"), text("dest_path")).alias("dest_path"),
        text("backup_path").alias("backup_path"), text("resolution").alias("resolution"), text("error").alias("error"),
    )


def append_audit(events: DataFrame, path: str) -> None:
    """Appends events to the audit log, one JSON object per line."""
    events.select(*AUDIT_COLUMNS).write.mode("append").json(path)


def backup_rows(target: DataFrame, replaced: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows about to be replaced or removed, with the reason; append before applying."""
    return target.join(replaced.select(key).distinct(), key, "left_semi").withColumn("backup_reason", F.lit(reason))
