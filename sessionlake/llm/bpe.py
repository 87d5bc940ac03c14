"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one last token that a
correct encoding of that prefix can end with. So the encoder walks through the
bytes and stores this token for each prefix; following them backwards gives the
encoding of any prefix. A candidate (a token that ends here) is the right one
if it may stand after the last token of the prefix before it, and that is a
question about two tokens only (``Ranks.adjacent``).

Since prefixes are stored, text can be appended exactly without encoding what
came before again (``Prefixes.append``), and after an edit the encoding is taken up
where the texts begin to differ (``Prefixes.edit``).

Defined results: a null or empty text has no tokens. A lone surrogate is not
valid in Spark strings and cannot occur. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, texts

#: Pieces whose encodings a task remembers at most, twice: the memory is then
#: begun anew, and what is met again is taken over from the one before.
REMEMBERED = 300_000


class Ranks:
    """A vocabulary: token bytes by rank, and which tokens may be neighbours."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: r for r, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        #: The two tokens whose merge makes a token; a single byte has none.
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        #: Only tokens that are the encoding of their own bytes can be output.
        self.reached = [True] * len(tokens)
        self._may: dict[tuple[int, int], bool] = {}
        for r, t in enumerate(tokens):
            if len(t) > 1:
                parts = self._merge(t, r)
                self.reached[r] = len(parts) == 2
                if self.reached[r]:
                    self.halves[r] = (parts[0], parts[1])
        self.usable = {t: r for t, r in self.rank.items() if self.reached[r]}
        #: Finds all tokens that end at each byte; bytes are the characters 0 to 255.
        self.ending = ahocorasick.Automaton()
        for t, r in self.usable.items():
            self.ending.add_word(t.decode("latin-1"), (r, len(t)))
        self.ending.make_automaton()

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """``piece`` by merges of rank less than ``below``, the lowest first."""
        parts = [self.rank[piece[i:i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            merged = [self.rank.get(self.tokens[a] + self.tokens[b], below) for a, b in zip(parts, parts[1:])]
            best = min(merged)
            if best >= below:
                break
            k = merged.index(best)
            parts[k:k + 2] = [best]
        return parts

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens encode their bytes together.

        They do unless some merge across the border would come before the
        merges that made them; undoing the later of the two shows the border
        as it was at each step.
        """
        pair = (left, right)
        if (known := self._may.get(pair)) is not None:
            return known
        a, b, limit, may = left, right, len(self.tokens) * 2, True
        while True:
            joined = self.rank.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                may = False
                break
            if a > b:
                limit = a
                if self.halves[a] is None:
                    break
                a = self.halves[a][1]
                if a == limit:
                    break
            else:
                limit = b
                if self.halves[b] is None:
                    break
                # Of equal merges the left one comes first.
                limit += 1
                b = self.halves[b][0]
                if b + 1 == limit:
                    break
        if len(self._may) > 2_000_000:
            self._may.clear()
        self._may[pair] = may
        return may


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from a rank file."""
    with open(path, "rb") as f:
        found = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    return [found[r] for r in range(len(found))]


class Prefixes:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        adjacent, known, last = self.ranks.adjacent, self.ranks._may, self.last
        start = len(self.piece)
        self.piece += more
        back = max(0, start - self.ranks.longest + 1)
        for end, (token, size) in self.ranks.ending.iter(self.piece[back:].decode("latin-1")):
            end += back
            if end != len(last):  # before the new bytes, or decided
                continue
            if size > end:
                last.append(token)
            else:
                left = last[end - size]
                may = known.get((left, token))
                if may or may is None and adjacent(left, token):
                    last.append(token)
        if len(last) != len(self.piece):
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, piece: bytes) -> int:
        """Makes this the prefixes of ``piece``; gives the number of bytes whose work was kept."""
        same, most = 0, min(len(piece), len(self.piece))
        while same < most and piece[same] == self.piece[same]:
            same += 1
        self.piece, self.last = piece[:same], self.last[:same]
        self.append(piece[same:])
        return same

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        at, out = len(self.piece) if end is None else end, []
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.ranks.tokens[token])
        return out[::-1]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.ranks = Ranks(tokens)
        self.find = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode()
            whole = self.ranks.usable.get(raw)
            ids = [whole] if whole is not None else Prefixes(self.ranks, raw).tokens()
            found = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        if len(piece) <= 64:
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        piece = self.piece
        return b"".join([self.known.get(p) or piece(p) for p in self.find(text)])

    def extend(self, text: str, ids: bytes, more: str) -> bytes:
        """The ids of ``text + more``, given those of ``text``: only its end,
        from the last white space before which no match can change, is matched again."""
        starts = [m.start() for m in self.spans(text, max(0, len(text) - 256))] if len(text) > 256 else []
        safe = next((s for s in reversed(starts[1:-3]) if text[s] == " " and not text[s + 1].isspace() and not text[s - 1].isspace()), 0)
        tail = self.encode(text[safe:])
        return ids[:len(ids) - len(tail)] + self.encode(text[safe:] + more)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple, Encoder] = {}


def _run(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], schema: str, outcome) -> DataFrame:
    """The ``keep`` columns of ``docs`` and those of ``schema``, made by
    ``outcome(encoder, text)``; ``docs`` has a column ``text``."""
    spark = docs.sparkSession
    vocabulary_ = spark.sparkContext.broadcast(read_ranks(path))  # one file of under 1 MB
    names = [c.split()[0] for c in schema.split(", ")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (path, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(vocabulary_.value, pattern)
        encoder = _ENCODERS[key]
        for b in batches:
            out = pd.DataFrame([outcome(encoder, t) for t in b.text], columns=names)
            out.insert(0, "kept", b.kept)
            yield out

    kept_type = held.schema["kept"].dataType.simpleString()
    return held.mapInPandas(run, f"kept {kept_type}, {schema}").select("kept.*", *names)


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, n_tokens and ids of every document; ids are
    packed little-endian unsigned 32-bit integers."""
    def outcome(encoder, text):
        ids = encoder.encode(text)
        return len(ids) // 4, ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in keep])
    return _run(rows, path, pattern, ("doc_id", *keep), "n_tokens long, ids binary", outcome)


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts are encoded, and the ids decoded."""
    def outcome(encoder, text):
        ids = encoder.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()
    return _run(texts(docs, id_col, text_col), path, pattern, ("doc_id",),
                "n_tokens long, ids_sha256 string, decoded_sha256 string", outcome)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_bpe(spark, sf_dir):
    return encoded_digests(load(spark, sf_dir, "documents"), *vocabulary())


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
