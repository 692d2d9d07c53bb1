"""Substring dedup: words covered by windows of `LENGTH` words that also start in a document with a smaller id.

The reference is the corpus itself, which has no size bound, so its shards are not broadcast whole: they are dealt by content-defined anchor
(`anchors`), and what may match a shard goes to the task that holds it. There a suffix automaton of the shard's pieces is built, and each piece is
streamed over it for matching statistics: at each word the longest match, and for its last 13 words the smallest id of a document that has them.

Defined results: a null text has no words; texts under 13 words keep all; a null id counts as larger than every other, and rows with one id (or none)
remove nothing from each other; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, placed, raw
from .repeats import NONE, Kind, Rule, repeated

LENGTH, GRAM, MANY, PORTION = 13, 4, 10_000, 8_000_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Automaton:
    """A suffix automaton of several sequences. least: the smallest owner of the sequences in which a state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [NONE]

    def _state(self, size: int, link: int, step: dict[int, int], least: int) -> int:
        self.next.append(step), self.link.append(link), self.size.append(size), self.least.append(least)
        return len(self.size) - 1

    def _parted(self, at: int, symbol: int) -> int:
        """The state after symbol whose longest string is one longer than at's; it is split off if need be."""
        to = self.next[at][symbol]
        if self.size[to] == self.size[at] + 1:
            return to
        copy = self._state(self.size[at] + 1, self.link[to], dict(self.next[to]), NONE)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def add(self, symbols: list[int], owner: int) -> None:
        last = 0
        for symbol in symbols:
            if symbol in self.next[last]:
                last = self._parted(last, symbol)
                self.least[last] = min(self.least[last], owner)
                continue
            at, last = last, self._state(self.size[last] + 1, 0, {}, owner)
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = last
                at = self.link[at]
            if at >= 0:
                self.link[last] = self._parted(at, symbol)

    def close(self) -> None:
        """Pass owners down the suffix links, longest strings first."""
        for k in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            to = self.link[k]
            self.least[to] = min(self.least[to], self.least[k])

    def owners(self, symbols: list[int], length: int) -> list[int]:
        """For each end of a match of at least `length` symbols, the smallest owner of the last `length` of them; else NONE."""
        state, size, out = 0, 0, []
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if symbol in self.next[state]:
                state, size = self.next[state][symbol], size + 1
            while state and self.size[self.link[state]] >= length:
                state = self.link[state]
                size = self.size[state]
            out.append(self.least[state] if size >= length else NONE)
        return out


def compare(pieces: list[np.ndarray], anchor: np.ndarray, own: np.ndarray, lead: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """hits[k, x]: whether window x of piece k also is in a piece of a smaller owner."""
    machine, symbols = Automaton(), [p.tolist() for p in pieces]
    for piece, owner in zip(symbols, own.tolist(), strict=True):
        machine.add(piece, owner)
    machine.close()
    hits = np.zeros((len(pieces), int(count.max())), bool)
    for k, (piece, owner) in enumerate(zip(symbols, own.tolist(), strict=True)):
        found = machine.owners(piece, length)[length - 1 :]
        hits[k, : len(found)] = [f < owner for f in found]
    return hits


def _pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces that end at white space."""
    at = 0
    while len(text) - at > most:
        end = SPACE.search(text, at + most)
        if not end:
            break
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def _words(text: bytes) -> np.ndarray:
    found = [[xxhash.xxh3_64_intdigest(w) for w in piece.split()] for piece in _pieces(text)]
    return np.concatenate([np.array(x, np.uint64) for x in found])


def kind(length: int = LENGTH) -> Kind:
    gram = min(GRAM, length)
    return Kind(_words, length, gram, PORTION, MANY, lambda *a: compare(*a, length=length))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, ranges in zip(raw(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
            words, ranges = (text or b"").split(), ranges or []
            a, b = covered(np.array([r["first"] for r in ranges], np.int64), np.array([r["last"] for r in ranges], np.int64))
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(words)]
            kept = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
            out.append((len(words), len(words) - len(kept), b" ".join(kept), [{"first": x, "last": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], spans), pa.array([hashlib.sha256(k).hexdigest() for k in columns[2]])], ["id", "n_words", "n_removed", "kept", "spans", "kept_sha256"])


def strip_copied(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_removed, kept: remaining words, spans: removed word ranges, kept_sha256) for each row of docs, which is read from files."""
    rows = placed(docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))).withColumn("owner", F.coalesce("id", F.lit(NONE)))
    ranges = repeated(rows, kind(length), Rule(F.col("owner"), F.min, lambda merged: F.col("owner") > F.col(merged)))
    return rows.select("id", "text", "row").join(ranges, "row", "left").select("id", "text", "ranges").mapInArrow(_strip, "id long, n_words long, n_removed long, kept string, spans array<struct<first: int, last: int>>, kept_sha256 string")
