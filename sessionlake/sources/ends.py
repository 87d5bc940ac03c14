"""First and last rows of files, by seeking: what lies between is never read.

A listing of a folder of large transcripts needs their first and last rows.
Each file's ends are read by one task, in blocks: from the start until enough
rows are found, and from a window before the end.  What is read of a file is
bounded by its lines, not by its size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.jsonvalues import parse_lines

BLOCK_BYTES = 64 * 1024
_ENDS = "file_path string, part string, line_no long, raw string, bytes_read long"


def _refuse(name: str):
    raise ValueError(name)


def _is_row(line: str) -> bool:
    try:
        json.loads(line, parse_constant=_refuse, parse_int=float)
        return True
    except (ValueError, RecursionError):
        return False


def _lines(data: bytes) -> list[str]:
    return [line.removesuffix(b"\r").decode("utf-8", "replace") for line in data.split(b"\n")]


def _head(source, size: int, limit: int) -> tuple[list[tuple[int, str]], int]:
    """The first ``limit`` rows with their line numbers, and the bytes read.

    The block grows, so that a long line is not read again and again."""
    found, rest, at, number, block = [], b"", 0, 0, BLOCK_BYTES
    while len(found) < limit and at < size:
        data = source.read(min(block, size - at))
        if not data:
            break
        at += len(data)
        rest, cut = rest + data, len(rest + data) if at >= size else (rest + data).rfind(b"\n")
        if cut < 0:
            block *= 2
            continue
        whole, rest = rest[:cut], rest[cut + 1:]
        for line in _lines(whole):
            number += 1
            line = line.removeprefix("﻿") if number == 1 else line
            if len(found) < limit and line.strip(fv.WHITE_SPACE) and _is_row(line.strip(fv.WHITE_SPACE)):
                found.append((number, line))
    return found, at


def _tail(source, size: int, limit: int, window: int) -> tuple[list[tuple[int, str]], int]:
    """The last ``limit`` rows among the lines that start inside the window,
    numbered backwards from -1, and the bytes read."""
    start, data, end = max(0, size - window), b"", size
    found: list[tuple[int, str]] = []
    block, read, number = BLOCK_BYTES, 0, 0
    while end > start and len(found) < limit:
        begin = max(start, end - block)
        source.seek(begin)
        piece = source.read(end - begin)
        read += len(piece)
        data, end = piece + data, begin
        block *= 2
        # The first line of what is here may have begun before it.
        cut, mark, rest = data.partition(b"\n") if begin > 0 else (b"", b"\n", data)
        if not mark:
            continue
        lines = _lines(rest)
        if begin == 0 and lines:
            lines[0] = lines[0].removeprefix("﻿")
        for line in reversed(lines):
            number -= 1
            text = line.strip(fv.WHITE_SPACE)
            if len(found) < limit and text and _is_row(text):
                found.append((number, line))
        data = cut + mark if begin > start else b""
    return found, read


def read_ends(
    inventory: DataFrame, head: int = fv.HEAD_ROWS, tail: int = fv.TAIL_ROWS, window_bytes: int = fv.TAIL_SCAN_BYTES
) -> DataFrame:
    """First ``head`` and last ``tail`` parseable rows of the listed files
    (``file_path, size_bytes``): ``file_path, part, line_no`` (negative, from the
    end, in the tail), ``raw, status, row, bytes_read``.

    The tail are rows that start inside the last ``window_bytes``.  A file that
    cannot be read has one row of ``part = 'error'`` with the message in ``raw``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch["file_path"]:
                try:
                    system, place = fs.FileSystem.from_uri(path)
                    with system.open_input_file(place) as source:
                        size = source.size()
                        first, a = _head(source, size, head)
                        last, b = _tail(source, size, tail, window_bytes)
                except OSError as error:
                    out.append((path, "error", 0, str(error)[:300], 0))
                    continue
                out += [(path, "head", n, line, a) for n, line in first] + [(path, "tail", n, line, b) for n, line in last]
            yield pd.DataFrame(out, columns=["file_path", "part", "line_no", "raw", "bytes_read"])

    spread = inventory.select("file_path").repartition("file_path")
    return parse_lines(spread.mapInPandas(run, _ENDS))
