"""Text, title and display functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionlake import fixed_values as fv


def _padded(text: Column) -> Column:
    space = F.lit(fv.WHITE_SPACE)
    return F.contains(space, F.substring(text, 1, 1)) | F.contains(space, F.substring(text, -1, 1))


def js_trim(text: Column) -> Column:
    """Trim the white space ECMAScript trims (more than Spark's ``trim``).

    Trimming by a set of characters walks the whole text, so it is done only
    where an end has something to trim.
    """
    return F.when(_padded(text), F.btrim(text, F.lit(fv.WHITE_SPACE))).otherwise(text)


def normalize_text(text: Column) -> Column:
    """CRLF to LF, no trailing blanks on any line, trimmed; null stays null.

    All tests are made on the text as it came: an end that needs no trim there
    needs none later, and lines end in blanks only where these pairs occur.
    """
    has = lambda part: F.contains(text, F.lit(part))
    unix = F.when(has("\r"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    ragged = has(" \n") | has("\t\n") | has("\r") | has("\u2028") | has("\u2029")
    cut = F.when(
        ragged, F.regexp_replace(unix, "[ \\t]+(?=[\\n\\r\\u2028\\u2029]|\\z)", "")
    ).otherwise(unix)
    return F.when(_padded(text), F.btrim(cut, F.lit(fv.WHITE_SPACE))).otherwise(cut)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, which is how transcripts count characters."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def normalize_title(title: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one space, trimmed."""
    folded = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " ")
    return F.trim(folded)


def bare_id(record_id: Column) -> Column:
    """Record id without its ``local_`` prefix, comparable with tombstone ids."""
    return F.regexp_replace(F.coalesce(record_id, F.lit("")), "^local_", "")


def is_uuid(value: Column, strict: bool = False) -> Column:
    return F.coalesce(value.rlike(fv.UUID_SHAPE if strict else fv.UUID_LOOSE), F.lit(False))


def short_uuid(value: Column) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, 8)


def millis_to_timestamp(ms: Column) -> Column:
    """Epoch milliseconds to timestamp; null for null, zero or negative."""
    return F.when(ms > 0, F.timestamp_millis(ms.cast("long")))


def parse_instant(iso: Column) -> Column:
    """ISO-8601 string to timestamp, null when it is not one."""
    return F.try_to_timestamp(iso)


def format_bytes(size: Column) -> Column:
    """Human-readable size: B, one decimal for KB and MB, two for GB."""
    fixed = lambda unit, digits: F.format_string(f"%.{digits}f", size / unit)
    return (
        F.when(size.isNull(), "—")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(fixed(1024.0, 1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(fixed(1024.0**2, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(1024.0**3, 2), F.lit(" GB")))
    )


def relative_age(instant: Column, now: Column) -> Column:
    """Age bucket relative to ``now``: just now, minutes, hours, days, date."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(instant.cast("timestamp"))) / 1_000_000
    bucket = lambda unit, suffix: F.concat(
        F.floor(seconds / unit).cast("string"), F.lit(suffix)
    )
    return (
        F.when(instant.isNull(), "—")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, bucket(60, "m ago"))
        .when(seconds < 86400, bucket(3600, "h ago"))
        .when(seconds < 7 * 86400, bucket(86400, "d ago"))
        .otherwise(F.date_format(instant, "yyyy-MM-dd HH:mm"))
    )


def size_warnings(size: Column, integrity: Column) -> Column:
    """Warning codes of a file, as an array in a fixed order."""
    codes = [F.when(integrity == code, F.lit(code)) for code in ("damaged", "unreadable", "truncated", "empty")]
    codes.append(
        F.when((size > 0) & (size < fv.STUB_BYTES) & (integrity != "empty"), F.lit("stub"))
    )
    codes.append(F.when(size > fv.HUGE_BYTES, F.lit("huge")))
    return F.array_compact(F.array(*codes))


def warning_level(code: Column) -> Column:
    return (
        F.when(code.isin("damaged", "unreadable", "empty", "scan-failed"), "error")
        .when(code == "huge", "info")
        .otherwise("warn")
    )


def integrity_rank(integrity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(fv.INTEGRITY_CLASSES) for x in (c, i)])
    return F.coalesce(F.try_element_at(ranks, integrity), F.lit(fv.UNKNOWN_RANK))


def is_usable(integrity: Column) -> Column:
    return F.coalesce(integrity.isin(*fv.USABLE), F.lit(False))


def require_usable(integrity: Column, value: Column) -> Column:
    """``value``, or a failed job when the source may not feed a write."""
    return F.when(is_usable(integrity), value).otherwise(
        F.raise_error(F.concat(F.lit("source is "), F.coalesce(integrity, F.lit("unknown"))))
    )


def group_key(project_path: Column, project_dir: Column) -> Column:
    present = lambda c: F.when(c != "", c)
    return F.coalesce(present(project_path), present(project_dir), F.lit("(no project)"))


def group_label(key: Column) -> Column:
    last = F.try_element_at(F.filter(F.split(key, r"[\\/]"), lambda p: p != ""), F.lit(-1))
    return F.when(key == "(no project)", key).otherwise(F.coalesce(last, key))


def natural_key(text: Column) -> Column:
    """Sort key: digit runs by value, letters without case or accents.

    Every digit run loses its leading zeros and is prefixed with its length,
    so a plain comparison of keys compares numbers by size.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    def keyed(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(
            run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        ).otherwise(run)
    return F.collate(F.array_join(F.transform(runs, keyed), ""), "UNICODE_CI_AI")


def pick_newer(a: Column, b: Column) -> Column:
    """'a' or 'b', whichever timestamp is later; null on a tie or when both miss."""
    epoch = F.lit(0).cast("timestamp")
    at, bt = F.coalesce(a, epoch), F.coalesce(b, epoch)
    return F.when(at > bt, "a").when(bt > at, "b")
