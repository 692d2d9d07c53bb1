"""The plan that suffix-array dedup and substring dedup share: which windows of a corpus repeat elsewhere.

1. One pass over the texts gives the anchors' contexts, which are written. Counts by anchor are aggregated before the shuffle and joined back, so that
   an anchor that a third of all documents hold is pre-aggregated and its join can be split.
2. Equal contexts are told by 128-bit digests besides their anchor, so that thousands of copies are one context in what follows. An anchor with one
   context repeats as a whole; of an anchor with several, equal contexts are counted in the same way.
3. Contexts that differ from others of their anchor are compared window by window by the operator's method, a bounded number of an anchor's contexts
   at a time. Anchors with more than `many` contexts are dealt by digests of their windows instead, so no task gathers them.
4. Ranges of repeated windows come back to their documents by one join on the row's number.

Rows are numbered by their place in their files (`placed`): each pass then gives the same numbers, however it splits the files, on retries too. A text
longer than a portion is cut into segments that overlap by a window less one symbol; each of its windows lies in one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import contexts
from .common import keep, portions, raw, release

CHUNK, SHAPE = 2000, 1 << 12
CONTEXT = "row long, owner long, first int, shape int, anchor long, context long, again long"
#: A context: its anchor and the halves of its digest.
KEY = ["anchor", "context", "again"]
NONE = (1 << 63) - 1


@dataclass
class Kind:
    """What tasks need. symbols: a text as an array; length, gram: of windows and grams; portion: bytes of text, or symbols of one text, handled at
    once; many: the most contexts of an anchor that a task compares together; compare: the method, from pieces of whole anchors, with anchor, own, lead
    and count of each, to hits[piece, window]."""

    symbols: Callable[[bytes], np.ndarray]
    length: int
    gram: int
    portion: int
    many: int
    compare: Callable[..., np.ndarray]

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length or self.length - self.gram + 1 >= SHAPE:
            raise ValueError(f"windows of {self.length} symbols: a context of {SHAPE} windows or more doesn't fit its shape")


@dataclass
class Rule:
    """own: what an occurrence tells; merge: the aggregate of it over equal windows; repeats: whether an occurrence repeats, given the aggregate."""

    own: Column
    merge: Callable[[str], Column]
    repeats: Callable[[str], Column]


def _segments(symbols: np.ndarray, most: int, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text with at most `most` symbols, and where each begins; every window lies in just one."""
    step = max(1, most - length + 1)
    for first in range(0, max(1, len(symbols) - length + 1), step):
        yield first, symbols[first : first + step + length - 1]


def _contexts(parts: list[np.ndarray], kind: Kind) -> tuple[np.ndarray, ...]:
    """Of texts: number of the text, first window in it, shape, anchor and both halves of the digest of each context."""
    ends, symbols = np.cumsum([len(p) for p in parts]), np.concatenate(parts)
    first, count, place, anchor = contexts(symbols, ends, kind.length, kind.gram)
    view, width = memoryview(symbols).cast("B"), symbols.itemsize
    digests = b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip((width * first).tolist(), (width * (first + count + kind.length - 1)).tolist(), strict=True)])
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    doc = np.searchsorted(ends, first, side="right")
    within = first - np.concatenate(([0], ends[:-1]))[doc]
    return doc, within, (place - first) * SHAPE + count, anchor.view(np.int64), halves[:, 0], halves[:, 1]


def _scan(kind: Kind):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch.column("text"))
            row, owner = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "owner"))
            for a, b in portions(texts, kind.portion):
                parts = [kind.symbols(t or b"") for t in texts[a:b]]
                for start, own in [(0, parts)] if b - a > 1 else ((at, [x]) for at, x in _segments(parts[0], kind.portion, kind.length)):
                    doc, within, shape, *key = _contexts(own, kind)
                    columns = [row[a:b][doc], owner[a:b][doc], (start + within).astype(np.int32), shape.astype(np.int32), *key]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["row", "owner", "first", "shape", *KEY])

    return scan


def _cut(kind: Kind):
    """The symbols of contexts, from the texts and each row's list of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = raw(batch.column("text")), batch.column("wanted").to_pylist()
            for a, b in portions(texts, kind.portion):
                out = []
                for text, rows in zip(texts[a:b], wanted[a:b], strict=True):
                    symbols = kind.symbols(text or b"")
                    out += [(*(w[c] for c in PIECES[:-1]), symbols[w["first"] : w["first"] + w["shape"] % SHAPE + kind.length - 1].tobytes()) for w in rows]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
                columns = list(zip(*out, strict=True)) or [()] * len(PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], PIECES)

    return cut


PIECE = "anchor long, context long, again long, own long, many boolean, shape int, piece binary"
PIECES = [c.split()[0] for c in PIECE.split(", ")]
WINDOWS = "anchor long, context long, again long, a int, b int"


def _ranges(key: list[np.ndarray], hits: np.ndarray) -> pa.RecordBatch:
    """Rows for the runs of true values of each line of hits."""
    edges = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    line, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    return pa.RecordBatch.from_arrays([*(pa.array(k[line]) for k in key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], [*KEY, "a", "b"])


def _compare(kind: Kind, dtype: np.dtype):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def judged(rows: list[tuple]) -> pa.RecordBatch:
            *key, own, shape = (np.array([r[k] for r in rows], np.int64) for k in range(5))
            return _ranges(key, kind.compare([np.frombuffer(r[5], dtype) for r in rows], key[0], own, shape // SHAPE, shape % SHAPE))

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in (*KEY, "own", "shape", "piece")), strict=True):
                if len(held) >= CHUNK and r[0] != held[-1][0]:
                    yield judged(held)
                    held = []
                held.append(r)
        if held:
            yield judged(held)

    return compare


def _explode(kind: Kind, dtype: np.dtype):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, own, shape, piece in zip(*(batch.column(c).to_pylist() for c in (*KEY, "own", "shape", "piece")), strict=True):
                width, n = dtype.itemsize, shape % SHAPE
                sums = [xxhash.xxh3_128_digest(piece[width * k : width * (k + kind.length)]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.binary()), *(pa.array([k] * n) for k in (*key, own)), pa.array(range(n), pa.int32())], ["window", *KEY, "own", "a"])

    return explode


def repeated(docs: DataFrame, kind: Kind, rule: Rule) -> DataFrame:
    """(row, ranges: array of half-open ranges of symbols that repeated windows cover) from docs (row, owner, text)."""
    dtype = kind.symbols(b"").dtype
    seen = keep(docs.select("row", "owner", "text").mapInArrow(_scan(kind), CONTEXT), "seen").withColumn("own", rule.own)
    same = F.max("context") == F.min("context"), F.max("again") == F.min("again")
    anchors = keep(seen.groupBy("anchor").agg(F.count("*").alias("n"), (~(same[0] & same[1])).alias("several"), rule.merge("own").alias("all")).where("n > 1"), "anchors")
    found = seen.join(anchors, "anchor").where(F.col("several") | rule.repeats("all"))
    found = keep(found.select("row", "owner", "first", "shape", *KEY, "own", "several"), "contexts")
    release(seen), release(anchors)
    last = F.col("first") + F.col("shape") % SHAPE + (kind.length - 1)
    plain = found.where("NOT several").select("row", "first", last.alias("last"))

    several = found.where("several").withColumn("mark", F.xxhash64("row", "first"))
    groups = keep(several.groupBy(*KEY).agg(rule.merge("own").alias("all"), F.min("mark").alias("least")), "groups")
    many = keep(groups.groupBy("anchor").count().where(F.col("count") > kind.many).select("anchor", F.lit(True).alias("many")), "many")  # few rows, if any
    groups = groups.join(many, "anchor", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    judged = keep(several.join(groups, KEY).withColumn("full", rule.repeats("all")), "judged")
    whole = judged.where("full").select("row", "first", last.alias("last"))
    wanted = judged.where("mark = least").groupBy("row").agg(F.collect_list(F.struct(*KEY, F.col("all").alias("own"), "many", "shape", "first")).alias("wanted"))
    pieces = keep(docs.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(_cut(kind), PIECE), "pieces")
    few = pieces.where("NOT many").repartition("anchor").sortWithinPartitions(*KEY).mapInArrow(_compare(kind, dtype), WINDOWS)
    split = pieces.where("many").mapInArrow(_explode(kind, dtype), "window binary, anchor long, context long, again long, own long, a int")
    totals = split.groupBy("window").agg(rule.merge("own").alias("all"))
    rest = split.join(totals, "window").withColumn("owner", F.col("own")).where(rule.repeats("all")).select(*KEY, "a", (F.col("a") + 1).alias("b"))
    parts = few.union(rest)
    fine = judged.where("NOT full").select("row", "first", *KEY).join(parts, KEY).select("row", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b") + (kind.length - 1)).alias("last"))
    ranges = keep(plain.union(whole).union(fine).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    for used in (found, judged, pieces):
        release(used)
    return ranges
