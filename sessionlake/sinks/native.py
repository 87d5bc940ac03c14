"""Normalised sessions back to native JSONL rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions.jsonvalues import quoted
from sessionlake.functions.paths import encode_project_dir
from sessionlake.operators.positions import running_total, with_previous
from sessionlake.session import shared
from sessionlake.sinks.files import write_files

# A run of assistant messages becomes one row.  ``max_blocks`` lets a longer run
# continue in further rows with the same message id, which readers put together
# again; without it a run of any length is one row.
NO_LIMIT = 2**62


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _short(prefix: str, n: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n))


def _object(*pairs: tuple[str, Column]) -> Column:
    """JSON object of ready-made JSON values, in the given order."""
    parts = []
    for n, (name, value) in enumerate(pairs):
        parts += [F.lit(f'{"," if n else "{"}"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _block() -> Column:
    """Content block of one message."""
    text = quoted(F.coalesce("text", F.lit("")))
    own = lambda prefix: _short(prefix, 20, F.col("uid").cast("string"), F.col("pos").cast("string"))
    use_id = F.coalesce(F.nullif(F.col("row_uuid"), F.lit("")), own("toolu_"))
    answered = F.coalesce(
        F.nullif(F.get_json_object("tool_input", "$.tool_use_id"), F.lit("")),
        F.nullif(F.get_json_object("tool_input", "$.call_id"), F.lit("")), own("toolu_"))
    return (
        F.when((F.col("role") == "assistant") & (F.col("type") == "thinking"),
               _object(("type", quoted(F.lit("thinking"))), ("thinking", text), ("signature", F.lit('""'))))
        .when((F.col("role") == "assistant") & (F.col("type") == "tool_use"),
              _object(("type", quoted(F.lit("tool_use"))), ("id", quoted(use_id)),
                      ("name", quoted(F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.lit("unknown")))), ("input", F.coalesce("tool_input", F.lit("{}")))))
        .when((F.col("role") != "assistant") & ((F.col("role") == "tool") | (F.col("type") == "tool_result")),
              _object(("type", quoted(F.lit("tool_result"))), ("tool_use_id", quoted(answered)),
                      ("content", F.when(F.col("text").isNotNull(), quoted(F.col("text"))).otherwise(F.coalesce("tool_output", F.lit('""')))),
                      ("is_error", F.lit("false"))))
        .otherwise(_object(("type", quoted(F.lit("text"))), ("text", text)))
    )


def build_rows(messages: DataFrame, sessions: DataFrame, now: Column | None = None, max_blocks: int = NO_LIMIT) -> DataFrame:
    """Native rows: ``uid, row_no, part_no, row_json``, chained by parent id.

    Consecutive assistant messages share a row; tool results go on user rows.
    Ids are derived from session and position, so a rerun writes the same.
    ``messages``: ``uid, pos`` and the message columns (``row_uuid``, ``ts``);
    ``sessions``: ``uid, session_id, project_path, model, git_branch``.
    """
    staged = with_previous(messages.withColumn("_block", _block()), ["uid"], "pos", ["role"])
    starts = ~((F.col("role") == "assistant") & F.coalesce(F.col("prev_role") == "assistant", F.lit(False)))
    placed = running_total(staged.withColumn("_start", starts.cast("long")), ["uid"], "pos", "_start", "run_no")
    placed = shared(placed.drop("_start", "prev_role", "text"), "native-runs")
    runs = placed.groupBy("uid", "run_no").agg(F.min("pos").alias("_from"), F.count("*").alias("_n"))
    # Last part of the run before, for the parent of a run's first row.
    before = runs.select("uid", (F.col("run_no") + 1).alias("run_no"), F.floor((F.col("_n") - 1) / max_blocks).alias("_prev_part"))
    parts = placed.join(runs.select("uid", "run_no", "_from"), ["uid", "run_no"]).withColumn(
        "part_no", F.floor((F.col("pos") - F.col("_from")) / max_blocks))
    first = F.min(F.struct("pos", "role", "type", "ts", "tool_output"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "_block")))
    grouped = parts.groupBy("uid", "run_no", "part_no").agg(
        first.alias("f"), F.array_join(F.transform(ordered, lambda x: x["_block"]), ",").alias("_blocks"))
    joined = grouped.join(before, ["uid", "run_no"], "left").join(
        sessions.select("uid", "session_id", "project_path", "model", "git_branch"), "uid")
    uid = F.col("uid").cast("string")
    name = lambda run, part: _uuid(uid, run.cast("string"), part.cast("string"))
    parent = F.when(F.col("part_no") > 0, name(F.col("run_no"), F.col("part_no") - 1)).when(
        F.col("_prev_part").isNotNull(), name(F.col("run_no") - 1, F.col("_prev_part")))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if now is None else now
    role = F.col("f.role")
    content = F.concat(F.lit("["), "_blocks", F.lit("]"))
    message = F.when(role == "assistant", _object(
        ("id", quoted(_short("msg_", 22, uid, F.col("run_no").cast("string")))), ("type", quoted(F.lit("message"))),
        ("role", quoted(F.lit("assistant"))), ("model", quoted(F.coalesce("model", F.lit("unknown")))),
        ("content", content), ("stop_reason", F.lit("null")))).otherwise(
        _object(("role", quoted(F.lit("user"))), ("content", content)))
    is_result = (role == "tool") | ((F.col("f.type") == "tool_result") & (role != "assistant"))
    head = [
        ("parentUuid", quoted(parent)), ("isSidechain", F.lit("false")), ("userType", quoted(F.lit("external"))),
        ("cwd", quoted(F.col("project_path"))), ("sessionId", quoted(F.col("session_id"))), ("version", quoted(F.lit("converted"))),
        ("gitBranch", quoted(F.col("git_branch"))), ("uuid", quoted(name(F.col("run_no"), F.col("part_no")))),
        ("timestamp", quoted(F.coalesce("f.ts", stamp))),
    ]
    # A system row holds its text directly; the block is {"type":"text","text":…}.
    system_text = F.expr("substring(_blocks, 23, length(_blocks) - 23)")
    row = (
        F.when(role == "system", _object(*head, ("type", quoted(F.lit("system"))), ("content", system_text), ("level", quoted(F.lit("info")))))
        .when(is_result & F.col("f.tool_output").isNotNull(),
              _object(*head, ("type", quoted(F.lit("user"))), ("message", message), ("toolUseResult", F.col("f.tool_output"))))
        .otherwise(_object(*head, ("type", quoted(F.when(role == "assistant", "assistant").otherwise("user"))), ("message", message)))
    )
    return joined.select("uid", (F.col("run_no") - 1).alias("row_no"), "part_no", row.alias("row_json"))


def suggested_path(project_path: Column, session_id: Column) -> Column:
    """Relative path a converted session belongs at."""
    return F.concat(F.lit("projects/"), encode_project_dir(project_path, "unknown-project"), F.lit("/"), session_id, F.lit(".jsonl"))


def write_native(rows: DataFrame, paths: DataFrame, target: str) -> DataFrame:
    """Writes each session as one JSONL file at its ``rel_path`` (``paths``:
    ``uid, rel_path``, see ``suggested_path``), so that it reads back as a transcript."""
    placed = rows.join(paths, "uid").select("rel_path", "row_no", "part_no", F.concat("row_json", F.lit("\n")).alias("value"))
    return write_files(placed, ["row_no", "part_no"], target)
