"""Suffix-array dedup: bytes covered by strings of `LENGTH` bytes that also start anywhere else in the corpus.

Suffixes are sorted where they can share a string: at content-defined anchors (`anchors`). The contexts of an anchor are ordered by the suffix that
starts at it and by the reversed text before it, both by deep-shallow sorting: multikey quicksort on 8-byte keys to a shallow depth, then blind tries
for groups with long common prefixes. Common prefixes of neighbours in the two orders say for each window whether another context has it.

Defined results: a null text has no bytes; texts under 200 bytes keep everything; copies of a text, also within one document, repeat each other and lose
all that they share; ids may be null or repeated, rows are told apart by their place; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, placed, raw
from .repeats import Kind, Rule, repeated

LENGTH, GRAM, SHALLOW, SMALL, MANY, PORTION = 200, 24, 6, 8, 50_000, 2_000_000


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


class Blind:
    """A trie that holds branching depths and first bytes only; strings are compared once for each insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        text, node = self.strings[k], self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(text[depth] if depth < len(text) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        shared = common(text, other)
        if shared == len(text) == len(other):
            node.append(k)
            return
        own, theirs = (s[shared] if shared < len(s) else -1 for s in (text, other))
        above, byte, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            above, byte = node, text[node[0]]
            node = node[1][byte]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][own] = [k]
            return
        fresh = (shared, {theirs: node, own: [k]})
        if above is None:
            self.root = fresh
        else:
            above[1][byte] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [child for _, child in sorted(node[1].items(), reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of strings, and each one's common prefix with its predecessor (-1 for the first)."""
    width = 8 * SHALLOW
    keys = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(-1, SHALLOW)
    order: list[int] = []
    stack = [(np.arange(len(strings)), 0)] if strings else []
    while stack:
        ids, depth = stack.pop()
        if len(ids) <= SMALL:
            order += sorted(ids.tolist(), key=strings.__getitem__)
        elif depth == SHALLOW:
            trie = Blind(strings)
            for k in ids.tolist():
                trie.add(k)
            order += trie.order()
        else:
            column = keys[ids, depth]
            pivot = np.partition(column, len(column) // 2)[len(column) // 2]
            parts = [(ids[column < pivot], depth), (ids[column == pivot], depth + 1), (ids[column > pivot], depth)]
            stack += [p for p in reversed(parts) if len(p[0])]
    sorted_ = [strings[k] for k in order]
    return np.array(order, np.int64), np.array([-1, *map(common, sorted_[:-1], sorted_[1:])][: len(order)], np.int64)


def compare(pieces: list[np.ndarray], anchor: np.ndarray, own: np.ndarray, lead: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """hits[k, x]: whether window x of context k is also in another context of its anchor."""
    heads, texts = [int(a).to_bytes(8, "big", signed=True) for a in anchor.tolist()], [p.tobytes() for p in pieces]
    sides = []
    for strings in ([h + t[n:] for h, t, n in zip(heads, texts, lead.tolist(), strict=True)], [h + t[:n][::-1] for h, t, n in zip(heads, texts, lead.tolist(), strict=True)]):
        order, shared = deep_shallow(strings)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sides.append((place, shared))
    hits = np.zeros((len(pieces), int(count.max())), bool)
    for at in range(-int(lead.max()), 1):
        x = lead + at
        inside = np.flatnonzero((x >= 0) & (x < count))
        if len(inside) < 2:
            continue
        right, left = (np.cumsum(shared < 8 + depth)[place[inside]] for (place, shared), depth in zip(sides, (length + at, -at), strict=True))
        _, group, size = np.unique(right * (len(pieces) + 1) + left, return_inverse=True, return_counts=True)
        again = inside[size[group] > 1]
        hits[again, x[again]] = True
    return hits


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def kind(length: int = LENGTH) -> Kind:
    gram = min(GRAM, length)
    return Kind(_bytes, length, gram, PORTION, MANY, lambda *a: compare(*a, length=length))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, ranges in zip(raw(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
            text, ranges = text or b"", ranges or []
            a, b = covered(np.array([r["first"] for r in ranges], np.int64), np.array([r["last"] for r in ranges], np.int64))
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(text), len(text) - len(kept), kept, [{"first": x, "last": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], spans), pa.array([hashlib.sha256(k).hexdigest() for k in columns[2]])], ["id", "n_bytes", "n_removed", "kept", "spans", "kept_sha256"])


def strip_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, kept: remaining bytes, spans: removed byte ranges, kept_sha256) for each row of docs, which is read from files."""
    rows = placed(docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))).withColumn("owner", F.lit(0).cast("long"))
    ranges = repeated(rows, kind(length), Rule(F.lit(1).cast("long"), F.sum, lambda merged: F.col(merged) > 1))
    return rows.select("id", "text", "row").join(ranges, "row", "left").select("id", "text", "ranges").mapInArrow(_strip, "id long, n_bytes long, n_removed long, kept binary, spans array<struct<first: int, last: int>>, kept_sha256 string")
