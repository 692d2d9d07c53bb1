"""Byte-level BPE with the tiktoken library and a local rank file: texts to ids, and ids to raw bytes.

The rank file is read once on the driver and broadcast (`MOST_RANKS` bytes at most), so workers need no copy of it; a worker builds one encoder. Texts of
over `PIECE` characters are cut at safe boundaries first, so that no text's ids are one list of Python numbers. A boundary is safe where the pattern
can't match across it, whatever stands around: before a space or line feed that follows a letter, digit or mark, and between a mark and a letter.
No alternative of the pattern has white space after anything else, and none has a mark other than the apostrophe before a letter. A run of `RUN` or more
white-space characters is a match of its own but for its last character, which the next match may take; it goes to the merges without the pattern,
whose engine would run out of stack.

Ids are kept as little-endian unsigned 32-bit integers in a binary column. Decoding joins the bytes of the ids and never goes through characters, so
pieces of a text, and ids that end within a character, decode as well.

Defined results: a null text is an empty one and has no ids; null ids decode to no bytes; an id that the ranks don't have is an error; strings of special
tokens are ordinary text; repeated rows give the same; other columns are not touched.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import portions_of

PIECE, RUN, PORTION, MOST_RANKS = 1_000_000, 10_000, 2_000_000, 64_000_000
#: White space as the pattern's engine has it.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Letters of kana and Han, which are letters in every Unicode version, and marks besides the apostrophe.
EAST = "-".join((chr(0x3041), chr(0x3096))) + "-".join((chr(0x30A1), chr(0x30FA))) + "-".join((chr(0x4E00), chr(0x9FFF)))
MARKS = ",.;:!?" + "".join(map(chr, (0x3001, 0x3002, 0xFF0C, 0xFF01, 0xFF1F)))
#: Between a letter, digit or mark and a space or line feed, or between a mark and a letter.
SAFE = re.compile(f"(?<=[!-~{EAST}])(?=[ \n])|(?<=[{MARKS}])(?=[A-Za-z{EAST}])")
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")


def ranks_of(file: bytes) -> dict[bytes, int]:
    """The ranks of a file: base64 of the bytes and the rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file.splitlines()))}


@lru_cache(1)
def encoder(file: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(file), special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[tuple[str, bool]]:
    """The text in pieces that the pattern matches apart, and whether a piece is a run of white space that is one match."""
    at = 0
    for run in [*LONG_RUN.finditer(text), None]:
        stop = run.start() if run else len(text)
        while at < stop:
            cut = SAFE.search(text, at + most, stop) if stop - at > most else None
            end = cut.start() if cut else stop
            yield text[at:end], False
            at = end
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True


def encode(own: tiktoken.Encoding, text: str, most: int = PIECE) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    if len(text) < RUN:
        return np.array(own.encode_ordinary(text), "<u4").tobytes()
    return b"".join(np.array(own._encode_single_piece(piece) if run else own.encode_ordinary(piece), "<u4").tobytes() for piece, run in pieces(text, most))


def decode(own: tiktoken.Encoding, ids: bytes, most: int = PIECE) -> bytes:
    numbers = np.frombuffer(ids, "<u4")
    return b"".join(own.decode_bytes(numbers[at : at + most].tolist()) for at in range(0, len(numbers), most))


class Ranks:
    """A rank file for Spark: columns of ids and of bytes."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            found = file.read(MOST_RANKS + 1)
        if len(found) > MOST_RANKS:
            raise ValueError(f"{path} has over {MOST_RANKS} bytes")
        self.sent, self.pattern = spark.sparkContext.broadcast(found), pattern

    def encoded(self, text: Column | str, most: int = PIECE) -> Column:
        """The ids of each text, as binary."""
        sent, pattern = self.sent, self.pattern

        @F.arrow_udf("binary")
        def of(texts: pa.Array) -> pa.Array:
            own, out = encoder(sent.value, pattern), []
            for a, b in portions_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), PORTION):
                out += [encode(own, t or "", most) for t in texts[a:b].to_pylist()]
            return pa.array(out, pa.binary())

        return of.asNondeterministic()(text)  # so that Spark doesn't encode again for each use of the ids

    def decoded(self, ids: Column | str) -> Column:
        """The bytes that each row's ids stand for."""
        sent, pattern = self.sent, self.pattern

        @F.arrow_udf("binary")
        def of(column: pa.Array) -> pa.Array:
            own = encoder(sent.value, pattern)
            return pa.array([decode(own, i.as_py() or b"") for i in column], pa.binary())

        return of(ids)


def n_tokens(ids: Column | str) -> Column:
    return F.floor(F.coalesce(F.octet_length(ids), F.lit(0)) / 4)
