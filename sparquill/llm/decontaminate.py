"""Benchmark decontamination: an Aho-Corasick automaton over the normalised windows of benchmark items, one scan of each text.

Normalising lower-cases A-Z and keeps words of digits, letters and non-ASCII characters, so that byte offsets in the normalised words map to the
original. A benchmark whose windows have up to `BLOCK_CHARS` characters is one automaton. A larger one is cut into such blocks, which are streamed over
the driver one at a time and broadcast on their own, so that no broadcast grows with it; a text is read and normalised once, and its blocks' automata
run over it in turn within one function.

Defined results: a null or empty text has no words and is clean; an item without words has no window; a null item id counts as the empty string;
items with one id are one item; repeated documents are judged alike; other columns are neither read nor changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import covered, portions, raw

WINDOW, BLOCK_CHARS, PORTION = 10, 2_000_000, 2_000_000
#: Everything but digits, letters and non-ASCII bytes becomes a space; A-Z become a-z.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KIND = "struct<n_words: bigint, ranges: array<struct<first: int, last: int>>, items: array<string>, spans: array<struct<first: int, last: int>>>"


def windows(text: bytes | None, size: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    words = (text or b"").translate(NORMAL).split()
    n = min(size, len(words))
    if n:
        for k in range(len(words) - n + 1):
            yield n, b" " + b" ".join(words[k : k + n]) + b" "


def blocks(items: DataFrame, id: str, text: str, size: int, most: int) -> Iterator[dict[bytes, tuple[int, list[str]]]]:
    """The windows of the items, streamed over the driver and cut into blocks."""
    block, chars = {}, 0
    for item, value in items.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text)).toLocalIterator(prefetchPartitions=True):
        for n, window in windows((value or "").encode(), size):
            own = block.setdefault(window, (n, []))[1]
            if item not in own:
                own.append(item)
                chars += len(window)
            if chars >= most:
                yield block
                block, chars = {}, 0
    if block:
        yield block


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, sent) -> ahocorasick.Automaton:
    """Of a block that was sent by broadcast; the last two are held in a worker."""
    if key not in _built:
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        found = _built[key] = ahocorasick.Automaton()
        for window, value in sent.value.items():
            found.add_word(window.decode("latin-1"), value)
        found.make_automaton()
    return _built[key]


def _byte_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets in the original text of ranges of words."""
    kept = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate(([False], kept, [False])).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [{"first": int(first[a]), "last": int(last[b - 1])} for a, b in ranges]


def _found(text: bytes, joined: bytes, n_words: int, hits: list[tuple[int, tuple[int, list[str]]]]) -> dict:
    """What a text's hits (last byte in the normalised text, and words and items of the window) come to."""
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    at = np.searchsorted(spaces, [end for end, _ in hits])
    a, b = covered(at - np.array([n for _, (n, _) in hits]), at)
    ranges = list(zip(a.tolist(), b.tolist(), strict=True))
    items = sorted({i for _, (_, own) in hits for i in own})
    return {"n_words": n_words, "ranges": [{"first": a, "last": b} for a, b in ranges], "items": items, "spans": _byte_spans(text, ranges)}


def _scan(sent: list[tuple]):
    """A function of texts over the automata of all blocks, which run over a portion of normalised texts one after another."""

    @F.arrow_udf(KIND)
    def scan(texts: pa.Array) -> pa.Array:
        own, out = raw(texts), []
        for first, last in portions(own, PORTION):
            words = [(text or b"").translate(NORMAL).split() for text in own[first:last]]
            joined = [b" " + b" ".join(w) + b" " for w in words]
            hits: list[list] = [[] for _ in words]
            for key, block in sent:
                machine = _automaton(key, block)
                for found, text in zip(hits, joined, strict=True):
                    found += machine.iter(text.decode("latin-1"))
            for text, w, line, found in zip(own[first:last], words, joined, hits, strict=True):
                out.append(_found(text, line, len(w), found) if found else {"n_words": len(w), "ranges": [], "items": [], "spans": []})
        return pa.array(out, _arrow())

    return scan


def _arrow() -> pa.DataType:
    ranges = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.struct([("n_words", pa.int64()), ("ranges", ranges), ("items", pa.list_(pa.string())), ("spans", ranges)])


def contamination(docs: DataFrame, items: DataFrame, text: Column | str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Column:
    """A struct for each text: n_words, ranges (of hit words, half open), items (sorted ids as strings) and spans (byte offsets of the ranges)."""
    context = docs.sparkSession.sparkContext
    return _scan([(uuid.uuid4().hex, context.broadcast(block)) for block in blocks(items, item_id, item_text, window, block_chars)])(text)


def n_hit(found: Column) -> Column:
    return F.aggregate(found["ranges"], F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"])
