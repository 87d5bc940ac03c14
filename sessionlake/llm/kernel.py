"""Vectorised text work inside tasks: many texts as one byte buffer, runs of bytes, hashes of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: One random number for each byte value, and byte values in lower case (A-Z only).
BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: anything but white space; and letters, digits and bytes beyond ASCII.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def chunks(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts as (first, buffer, ends): each text is followed by a
    space, ``ends`` has the place after it. A chunk has about ``limit`` bytes or
    one longer text."""
    raw, first, held = [], 0, 0
    for k, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        raw.append(b)
        held += len(b) + 1
        if held >= limit:
            yield first, *_joined(raw)
            raw, first, held = [], k + 1, 0
    if raw:
        yield first, *_joined(raw)


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), ends


def runs(buffer: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = member[buffer]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, U64(_BASE))]))
            down = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, U64(_INVERSE))]))
        if size > 4 * _BLOCK:
            return up, down
        _powers[size] = (up, down)
    return _powers[size]


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, in blocks of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK)))
            s, e = starts[at:to] - base, ends[at:to] - base
            up, down = _powers_to(int(e[-1]))
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(BYTES[buffer[base:base + int(e[-1])]] * up[:int(e[-1])], out=sums[1:])
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
    return mixed(out)


def owners(ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text that each run belongs to."""
    return np.searchsorted(ends, starts, side="right")
