"""From heterogeneous rows to the flat message table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions import hashing
from sessionlake.functions.jsonvalues import canonical, evaluate_once, field, quoted, text_field
from sessionlake.operators.positions import RUN_LENGTH, dense_position
from sessionlake.session import shared

MESSAGE_COLUMNS = (
    "file_path", "line_no", "block_no", "message_id", "row_uuid", "parent_uuid", "role", "type",
    "text", "tool_name", "tool_input", "tool_output", "ts", "fingerprint", "msg_digest",
)


def rows(lines: DataFrame) -> DataFrame:
    """Parsed rows with ``row_type`` (``unknown`` without one), ``message_id``
    and whether they carry a message."""
    row = F.col("row")
    message = field(row, "$.message")
    kind = F.coalesce(text_field(row, "$.type"), F.lit("unknown"))
    return evaluate_once(
        lines.where("status = 'ok'").select("file_path", "line_no", "row"),
        row_type=kind,
        # The id only groups the rows of one turn; a row without any is a turn
        # of its own, named by its line.
        message_id=F.coalesce(
            text_field(row, "$.message.id"), text_field(row, "$.uuid"), F.concat(F.lit("line-"), "line_no")
        ),
        is_message=kind.isin(*fv.MESSAGE_ROW_TYPES)
        & ~F.coalesce(message.isin("null", "", "false", "0"), F.lit(True)),
    )


def raw_rows(parsed: DataFrame) -> DataFrame:
    """Rows that are not messages, kept verbatim for a lossless round trip."""
    return parsed.where(~F.col("is_message")).select(
        "file_path", "line_no", "row_type", canonical(F.col("row")).alias("row_json")
    )


def content_blocks(content: Column) -> Column:
    """Content as an array of blocks: a string is one text block, an object is
    one block, an array is itself, anything else is nothing."""
    as_array = content.try_cast("array<variant>")
    as_object = content.try_cast("map<string,variant>")
    text_block = F.to_variant_object(
        F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), content.try_cast("string"))
    )
    return (
        F.when(as_array.isNotNull(), as_array)
        .when(as_object.isNotNull(), F.array(content))
        .when(F.schema_of_variant(content) == "STRING", F.array(text_block))
    )


def blocks(parsed: DataFrame) -> DataFrame:
    """One row per content block, before duplicates are dropped.

    Only object blocks (and nested arrays) count; strings or numbers inside a
    content array are skipped.
    """
    row = F.col("row")
    exploded = parsed.where("is_message").select(
        "file_path", "line_no", "message_id",
        field(row, "$.uuid").alias("row_uuid"),
        field(row, "$.parentUuid").alias("parent_uuid"),
        field(row, "$.timestamp").alias("ts"),
        F.when(field(row, "$.message.role") == "assistant", "assistant").otherwise("user").alias("side"),
        F.posexplode(content_blocks(field(row, "$.message.content", "variant"))).alias("block_no", "block"),
    )
    block = F.col("block")
    content = field(block, "$.content", "variant")
    opened = evaluate_once(
        exploded,
        json=canonical(block),
        kind=field(block, "$.type"),
        content=content,
        parts=content.try_cast("array<variant>"),
        use_id=text_field(block, "$.tool_use_id"),
    ).where(F.substring("json", 1, 1).isin("{", "["))
    mapped = map_block(opened).withColumn("fingerprint", hashing.block_fingerprint(F.col("json")))
    return mapped.withColumn("msg_digest", hashing.message_digest()).drop("json")


def map_block(frame: DataFrame) -> DataFrame:
    """Maps an opened ``block`` to the message columns."""
    block, kind, content, parts, use_id = (F.col(c) for c in ("block", "kind", "content", "parts", "use_id"))
    texts = F.filter(parts, lambda c: field(c, "$.type") == "text")
    joined = F.array_join(F.transform(texts, lambda c: F.coalesce(field(c, "$.text"), F.lit(""))), "\n")
    result_text = F.when(parts.isNotNull(), F.when(joined != "", joined)).when(
        F.schema_of_variant(content) == "STRING", field(block, "$.content")
    )
    other = ~F.coalesce(kind.isin("text", "thinking", "tool_use", "tool_result", "image"), F.lit(False))
    image = F.concat(
        F.lit('{"imageSource":'), quoted(F.coalesce(field(block, "$.source.type"), F.lit("unknown"))),
        F.lit(',"mediaType":'), quoted(field(block, "$.source.media_type")), F.lit("}"),
    )
    # Absent and null alike are stored as null.
    present = lambda json: F.when(json != "null", json)
    columns = dict(
        role=F.when(kind.isin("thinking", "tool_use"), "assistant").when(kind == "tool_result", "tool")
        .otherwise(F.col("side")),
        type=F.when(kind.isin("thinking", "tool_use", "tool_result"), kind).otherwise("text"),
        text=F.when(kind == "text", field(block, "$.text"))
        .when(kind == "thinking", F.coalesce(field(block, "$.thinking"), field(block, "$.text")))
        .when(kind == "tool_result", result_text)
        .when(kind == "image", "[image]"),
        tool_name=F.when(kind.isin("tool_use", "tool_result"), field(block, "$.name"))
        .when(other, F.coalesce(kind, F.lit("unknown"))),
        tool_input=F.when(kind == "tool_use", present(canonical(field(block, "$.input", "variant"))))
        .when((kind == "tool_result") & use_id.isNotNull(),
              F.concat(F.lit('{"tool_use_id":'), quoted(use_id), F.lit("}"))),
        tool_output=F.when(kind == "tool_result", present(canonical(content)))
        .when(kind == "image", image)
        .when(other, F.col("json")),
    )
    return evaluate_once(frame, **columns).drop("block", "kind", "content", "parts", "use_id", "side")


def drop_repeated_blocks(frame: DataFrame) -> DataFrame:
    """Keeps the first of equal blocks of one message (split turns repeat them).

    The key is message id plus fingerprint: different blocks that share an id
    all survive.  Ranking to one row is cut per partition before the shuffle,
    so a block repeated a billion times costs one row per task.
    """
    first = W.partitionBy("file_path", "message_id", "fingerprint").orderBy("line_no", "block_no")
    return frame.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def drop_repeats_in_window(frame: DataFrame, window: int = fv.DEDUPE_WINDOW_IDS) -> DataFrame:
    """``drop_repeated_blocks`` as readers do it that remember only the latest
    ``window`` message ids, first in, first out.

    Which ids are remembered depends on all rows before, so the keys of a file
    are one ordered stream in one task: ids and fingerprints only, of which at
    most ``window`` ids are held.  Blocks themselves are joined afterwards.  A
    row without blocks does not count as a sight of its id.
    """
    keys = frame.select("file_path", "line_no", "block_no", "message_id", "fingerprint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, held = None, {}
        for batch in batches:
            fresh = []
            for path, message, block in zip(batch["file_path"], batch["message_id"], batch["fingerprint"]):
                if path != file:
                    file, held = path, {}
                if message not in held:
                    held[message] = set()
                    if len(held) > window:
                        del held[next(iter(held))]
                # With room for none, a message is remembered by no one.
                seen = held.get(message, set())
                fresh.append(block not in seen)
                seen.add(block)
            yield batch.loc[fresh, ["file_path", "line_no", "block_no"]]

    ordered = keys.repartition("file_path").sortWithinPartitions("file_path", "line_no", "block_no")
    kept = ordered.mapInPandas(run, "file_path string, line_no long, block_no int")
    return frame.join(kept.withColumn("block_no", F.col("block_no").cast(frame.schema["block_no"].dataType)), ["file_path", "line_no", "block_no"])


def repeated_blocks(frame: DataFrame) -> DataFrame:
    """Number of collapsed duplicates per file."""
    groups = frame.groupBy("file_path", "message_id", "fingerprint").agg(F.count("*").alias("_n"))
    return groups.groupBy("file_path").agg(F.sum(F.col("_n") - 1).alias("duplicate_blocks"))


def messages(lines: DataFrame, with_position: bool = True) -> DataFrame:
    """The message table of classified, numbered lines.

    Positions need a second look at the keys of the surviving blocks, so the
    parsed messages are written once before they are numbered.
    """
    kept = drop_repeated_blocks(blocks(rows(lines))).select(*MESSAGE_COLUMNS)
    if not with_position:
        return kept
    return positions(shared(kept, "messages"))


def positions(kept: DataFrame) -> DataFrame:
    """Adds ``pos``, the 0-based place of each message in its transcript."""
    return dense_position(kept, ["file_path"], ["line_no", "block_no"], F.floor(F.col("line_no") / RUN_LENGTH))


def tool_result_backfill(parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """Structured tool output stored beside a user row, for display.

    Fills ``tool_output`` of the last message of the row when it is a tool
    result without one.  The content digest never sees it: one and the same
    file would otherwise hash differently depending on how it was read.
    """
    extra = parsed.where(field(F.col("row"), "$.toolUseResult", "variant").isNotNull()).select(
        "file_path", "line_no", canonical(field(F.col("row"), "$.toolUseResult", "variant")).alias("_result")
    )
    last = kept.groupBy("file_path", "line_no").agg(F.max("block_no").alias("block_no"))
    filled = extra.join(last, ["file_path", "line_no"])
    joined = kept.join(filled, ["file_path", "line_no", "block_no"], "left")
    usable = (F.col("type") == "tool_result") & F.col("tool_output").isNull()
    return joined.withColumn(
        "tool_output", F.when(usable, F.col("_result")).otherwise(F.col("tool_output"))
    ).drop("_result")


def row_type_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("file_path", "row_type").agg(F.count("*").alias("n_rows"))


def models_seen(parsed: DataFrame) -> DataFrame:
    """Messages per model and file, with the line each model first occurs on."""
    return (
        parsed.where("is_message")
        .select("file_path", "line_no", text_field(F.col("row"), "$.message.model").alias("model"))
        .where("model is not null")
        .groupBy("file_path", "model")
        .agg(F.count("*").alias("n_rows"), F.min("line_no").alias("first_line"))
    )


def dominant_model(seen: DataFrame, keys: tuple[str, ...] = ("file_path",), first: str = "first_line") -> DataFrame:
    """Model of most messages; ties go to the one seen first."""
    return (
        seen.where(F.col("model") != fv.SYNTHETIC_MODEL)
        .groupBy(*keys)
        .agg(F.max_by("model", F.struct("n_rows", -F.col(first))).alias("model"))
    )
