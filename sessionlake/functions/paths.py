"""Path functions: folder encoding, portable relative paths, suffix names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from sessionlake import fixed_values as fv


def clean_path(path: Column) -> Column:
    """Path of a scanned file without the ``file:`` scheme or URI escapes."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    decoded = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(plain, F.lit("%")), decoded).otherwise(plain)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


@F.pandas_udf(LongType())
def _polynomial(paths: pd.Series) -> pd.Series:
    """Absolute values of the hash; the powers of 31 wrap like its sums do."""
    units = [None if p is None else np.frombuffer(p.encode("utf-16-be"), ">u2").astype("uint32") for p in paths]
    powers = np.ones(max((len(u) for u in units if u is not None), default=0) + 1, "uint32")
    powers[1:] = 31
    powers = np.multiply.accumulate(powers, dtype="uint32")
    hashes = [None if u is None else abs(int((u * powers[:len(u)][::-1]).sum(dtype="uint32").astype("int32"))) for u in units]
    return pd.Series(hashes, dtype="Int64")


def path_hash(path: Column) -> Column:
    """Base-36 of the absolute value of a signed 32-bit polynomial hash.

    Runs over UTF-16 units of the original path; multiplier 31, wrapping.
    """
    return F.lower(F.conv(_polynomial(path).cast("string"), 10, 36))


def encode_project_dir(path: Column, missing: str = "") -> Column:
    """Folder name of a working directory: everything but letters and digits
    becomes a dash, long names are cut and completed by a hash."""
    raw = F.coalesce(path, F.lit(""))
    # A character gives one dash at least: these tell whether the name is long.
    head = F.substring(raw, 1, fv.PROJECT_DIR_MAX + 1)
    # One dash per UTF-16 unit: characters beyond the basic plane count twice.
    dashed = F.regexp_replace(
        F.regexp_replace(head, "[\\x{10000}-\\x{10FFFF}]", "--"), "[^A-Za-z0-9]", "-"
    )
    long_form = F.concat(
        F.substring(dashed, 1, fv.PROJECT_DIR_MAX), F.lit("-"), path_hash(F.when(F.length(dashed) > fv.PROJECT_DIR_MAX, raw))
    )
    encoded = F.when(F.length(dashed) <= fv.PROJECT_DIR_MAX, dashed).otherwise(long_form)
    return F.when(raw == "", F.lit(missing)).otherwise(encoded)


def decode_project_dir(name: Column) -> Column:
    """Readable guess of the path behind a folder name (ambiguous, display only)."""
    rest = F.replace(F.replace(F.substring(name, 4, 1 << 30), F.lit("--"), F.lit("\\")), F.lit("-"), F.lit(" "))
    return (
        F.when(name == "", F.lit(None).cast("string"))
        .when(name.rlike("^[A-Za-z]--"), F.concat(F.substring(name, 1, 1), F.lit(":\\"), F.trim(rest)))
        .when(F.startswith(name, F.lit("-")), F.replace(name, F.lit("-"), F.lit("/")))
        .otherwise(name)
    )


def _segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def safe_relative_path(path: Column) -> Column:
    """Portable relative path; null when it climbs out, names a drive or is empty."""
    parts = F.transform(_segments(path), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    refused = F.exists(kept, lambda p: (p == "..") | F.contains(p, F.lit(":")))
    return F.when(~refused & (F.size(kept) > 0), F.array_join(kept, "/"))


def safe_archive_name(path: Column) -> Column:
    """Portable member name: climbing segments and drive prefix are removed."""
    no_drive = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[A-Za-z]:", "")
    kept = F.filter(F.split(no_drive, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(kept, "/")


def contained_in(root: Column, target: Column) -> Column:
    """Whether target is root or below it (root followed by a separator)."""
    inside = (target == root) | F.startswith(target, F.concat(root, F.lit("/")))
    climbs = F.exists(F.split(target, "/"), lambda p: p == "..")
    return F.coalesce(inside & ~climbs & (root != "") & (target != ""), F.lit(False))


def suffixed_path(path: Column, suffix: Column) -> Column:
    """``dir/base--suffix.ext`` with the suffix reduced to safe characters."""
    clean = F.regexp_replace(suffix, "[^A-Za-z0-9_-]", "-")
    extension = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(extension))
    return F.concat(stem, F.lit("--"), clean, extension)
