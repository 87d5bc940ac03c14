"""Digests and identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionlake.functions.jsonvalues import quoted
from sessionlake.functions.text import normalize_text


def block_fingerprint(canonical_block: Column) -> Column:
    """16 base-64 characters of the SHA-1 of a block's canonical JSON."""
    return F.substring(F.base64(F.unhex(F.sha1(canonical_block))), 1, 16)


def session_uid(tool: Column, account: Column, path: Column) -> Column:
    """Identity of a transcript: tool, account and path hash joined by bars.

    Keyed by path because a session id may occur in several files.
    """
    return F.concat_ws("|", tool, account, F.substring(F.sha1(path), 1, 12))


def message_json(role, type_, text, tool_name, tool_input, tool_output) -> Column:
    """Canonical JSON of what counts for identity (no ids, times or paths).

    ``tool_input`` and ``tool_output`` are canonical JSON text already.
    """
    null = F.lit("null")
    return F.concat(
        F.lit('{"role":'), quoted(role),
        F.lit(',"text":'), quoted(normalize_text(text)),
        F.lit(',"toolInput":'), F.coalesce(tool_input, null),
        F.lit(',"toolName":'), quoted(tool_name),
        F.lit(',"toolOutput":'), F.coalesce(tool_output, null),
        F.lit(',"type":'), quoted(type_),
        F.lit("}"),
    )


def message_digest() -> Column:
    """SHA-256 of the canonical message, over the standard message columns."""
    return F.sha2(
        message_json(*(F.col(c) for c in ("role", "type", "text", "tool_name", "tool_input", "tool_output"))),
        256,
    )


def message_hash(digest: Column) -> Column:
    return F.substring(digest, 1, 16)
