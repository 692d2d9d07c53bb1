"""Ranked lexical search by bit-sliced Bloom signatures.

The index cuts documents into blocks of about equal size. A document's signature is a Bloom filter of its terms at `LEVELS`, of which each says that a
term occurs so often or more. A block keeps the filters as slices: one bitmap of its documents for each bit of the filter. The bitmaps of a term's bits, and-ed,
overestimate the documents that hold the term so often; from the level found, the document's known length and the term's weight follows an upper bound
of the term's share, and the sum over a question's terms bounds the document's score. Nothing else of a text is kept but, for each task, how many of its
documents hold each term.

A search makes two passes over the index for a block of questions. The first keeps the k highest bounds of each task and question; the k best of these
are scored exactly, which gives each question a score that k documents reach. The second finds every document whose bound reaches that score, so that
those left out can't be among the k best, and all those found are scored exactly from their whole texts. Nothing is capped.

A question's block has `TERMS` distinct terms and `QUESTIONS` questions at most, is streamed over the driver and broadcast; blocks are searched in turn.

Defined results: null and empty texts have no terms, aren't counted and aren't found; a question without terms, or whose terms no document has, has no
rows; questions with one id are ranked each on their own; documents with one id are all ranked, equal ones by their place in the files, and null ids after
all others of the same score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, placed, portions, raw
from .decontaminate import NORMAL

SEED, HASHES, BITS, K = 42, 8, 16, 20
#: A level says that a term occurs so often or more.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Documents and bytes of a block; entries that a task holds before it cuts blocks; distinct terms whose counts it holds.
DOCS, BLOCK_BYTES, HELD, VOCABULARY, PORTION = 1024, 2_000_000, 4_000_000, 100_000, 4_000_000
TERMS, QUESTIONS, BROADCAST_ROWS = 50_000, 2_000, 500_000
INDEX = "bits long, rows array<long>, sizes array<long>, slices binary, terms array<binary>, counts array<long>"


def terms(text: bytes | None) -> Counter:
    return Counter((text or b"").translate(NORMAL).split())


def hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64)


def at_level(h: np.ndarray, level: int) -> np.ndarray:
    """What a term's filter entry at a level is made of: a multiplicative mix, so that levels are independent."""
    h = (h + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def places(entries: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each entry in a filter of so many bits (a power of two): rows of places."""
    step = (entries >> np.uint64(32)) | np.uint64(1)
    return ((entries + step * np.arange(HASHES, dtype=np.uint64)[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _block(held: list[tuple[int, int, np.ndarray]], bits: int) -> pa.RecordBatch:
    slices = np.zeros((bits, -(-len(held) // 8)), np.uint8)
    for k, (_, _, entries) in enumerate(held):
        slices[places(entries, bits).ravel(), k >> 3] |= np.uint8(128 >> (k & 7))
    values = [bits, [r for r, _, _ in held], [n for _, n, _ in held], slices.tobytes(), None, None]
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, values, strict=True))], SCHEMA)


SCHEMA = pa.schema([("bits", pa.int64()), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, df = [], 0, Counter()

    def blocks() -> Iterator[pa.RecordBatch]:
        """Documents by the size of their filter."""
        held.sort(key=lambda d: len(d[2]))
        first = 0
        while first < len(held):
            bits = 1 << (BITS * len(held[first][2]) - 1).bit_length()
            most, last = max(8, min(DOCS, 8 * BLOCK_BYTES // bits)), first
            while last < len(held) and last - first < most and BITS * len(held[last][2]) <= bits:
                last += 1
            yield _block(held[first:last], bits)
            first = last

    def counts() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, [None] * 4 + [list(df), list(df.values())], strict=True))], SCHEMA)

    for batch in batches:
        rows, texts = batch.column(0).to_pylist(), raw(batch.column(1))
        for a, b in portions(texts, PORTION):
            for row, text in zip(rows[a:b], texts[a:b], strict=True):
                own = terms(text)
                if not own:
                    continue
                df.update(own.keys())
                h, tf = hashes(own), np.fromiter(own.values(), np.int64)
                entries = [at_level(h, 0)]
                for level in range(1, len(LEVELS)):
                    h, tf = h[often := tf >= LEVELS[level]], tf[often]
                    if not len(h):
                        break
                    entries.append(at_level(h, level))
                held.append((row, own.total(), np.concatenate(entries)))
                size += len(held[-1][2])
            if size > HELD:
                yield from blocks()
                held.clear()
                size = 0
            if len(df) > VOCABULARY:
                yield counts()
                df.clear()
    yield from blocks()
    if df:
        yield counts()


def build(docs: DataFrame, text: str = "text") -> DataFrame:
    """The index of docs, written: rows of blocks, and rows of counts. Rows are named by their place in the files of docs (`placed`)."""
    return keep(placed(docs.select(text), "row").select("row", text).mapInArrow(_index, INDEX), "signatures")


class Questions:
    """A block of questions against an index: distinct terms with hash and weight, and each question's terms with their number."""

    def __init__(self, asked: list[Counter], df: dict[bytes, int], n: int, length: int):
        self.n, self.length = n, length
        known = sorted({t for q in asked for t in q} & df.keys())
        self.at = {t: k for k, t in enumerate(known)}
        self.hashes = hashes(known)
        self.weight = np.array([floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) for t in known], np.int64)
        self.own = [np.array([(self.at[t], c) for t, c in sorted(q.items()) if t in self.at], np.int64).reshape(-1, 2) for q in asked]

    def share(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A term's share of the score but for its weight: rising with tf, falling with the document's size."""
        return 1_000_000_000 * tf // np.maximum(1000 * tf + 12 * (75 + 25 * size * self.n // self.length), 1)

    def bounds(self, bits: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """(questions, documents): what each document's score can be at most, from a block's slices."""
        rows, docs = np.frombuffer(slices, np.uint8).reshape(bits, -1), len(sizes)
        level, live = np.zeros((len(self.at), docs), np.int8), np.arange(len(self.at))
        maps = None
        for k in range(len(LEVELS)):
            found = np.bitwise_and.reduce(rows[places(at_level(self.hashes[live], k), bits)], axis=0)
            maps = found if maps is None else maps & found
            some = maps.any(axis=1)
            live, maps = live[some], maps[some]
            if not len(live):
                break
            level[live] += np.unpackbits(maps, axis=1, count=docs).view(np.int8)
        most = np.minimum(np.array([0, *(n - 1 for n in LEVELS[1:]), np.iinfo(np.int64).max])[:, None], sizes)
        share = self.share(most, sizes)
        out = np.zeros((len(self.own), docs), np.int64)
        some = level.any(axis=1)
        slot = np.cumsum(some) - 1
        worth = share[level[some], np.arange(docs)] * self.weight[some, None]
        for q, own in enumerate(self.own):
            own = own[some[own[:, 0]]]
            if len(own):
                out[q] = own[:, 1] @ worth[slot[own[:, 0]]]
        return out

    def scores(self, text: bytes | None, asked: list[int]) -> list[int]:
        """A text's exact scores for some of the questions."""
        own = terms(text)
        size, part = own.total(), np.zeros(len(self.at), np.int64)
        known = [(self.at[t], c) for t, c in own.items() if t in self.at]
        if known:
            at, tf = np.array(known, np.int64).T
            part[at] = self.weight[at] * self.share(tf, np.int64(size))
        return [int(self.own[q][:, 1] @ part[self.own[q][:, 0]]) for q in asked]


def _scan(sent, reach):
    """reach: rows that `reach(question, bounds)` selects from the bounds of a block; called with all bounds of the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = reach(sent.value)
        for batch in batches:
            for bits, rows, sizes, slices in zip(*batch.columns, strict=True):
                rows, sizes = rows.values.to_numpy(), sizes.values.to_numpy()
                yield from state.send(rows, sent.value.bounds(bits.as_py(), sizes, slices.as_buffer()))
        yield from state.rest()

    return scan


def _pairs(q: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(rows), pa.array(bound)], ["q", "row", "bound"])


class _Highest:
    """The k rows of highest bounds above 0 of each question."""

    def __init__(self, asked: Questions, k: int):
        self.k, self.rows, self.bound = k, np.zeros((len(asked.own), 0), np.int64), np.zeros((len(asked.own), 0), np.int64)

    def send(self, rows: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, bound = np.concatenate((self.rows, np.broadcast_to(rows, bound.shape)), axis=1), np.concatenate((self.bound, bound), axis=1)
        if bound.shape[1] > self.k:
            best = np.argpartition(-bound, self.k - 1, axis=1)[:, : self.k]
            rows, bound = np.take_along_axis(rows, best, 1), np.take_along_axis(bound, best, 1)
        self.rows, self.bound = rows, bound
        return iter(())

    def rest(self) -> Iterator[pa.RecordBatch]:
        q, at = np.nonzero(self.bound > 0)
        yield _pairs(q, self.rows[q, at], self.bound[q, at])


class _Reaching:
    """All rows whose bounds reach their question's score."""

    def __init__(self, score: np.ndarray):
        self.score = score

    def send(self, rows: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, at = np.nonzero(bound >= self.score[:, None])
        if len(q):
            yield _pairs(q, rows[at], bound[q, at])

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _exact(docs: DataFrame, pairs: DataFrame, sent, id: str, text: str) -> DataFrame:
    """(q, row, doc, score) of pairs (q, row), from whole texts. Few rows that are asked for are broadcast, so that texts stay where they are read."""
    wanted = keep(pairs.groupBy("row").agg(F.collect_list("q").alias("asked")), "wanted")
    few = wanted.agg(F.count("*") + F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    rows = placed(docs.select(F.col(id).alias("doc"), F.col(text).alias("text")), "row").join(F.broadcast(wanted) if few else wanted, "row")
    kinds = T.StructType([T.StructField("q", T.LongType()), T.StructField("row", T.LongType()), T.StructField("doc", docs.schema[id].dataType), T.StructField("score", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            texts = raw(batch.column(2))
            for a, b in portions(texts, PORTION):
                lists = [x.as_py() for x in batch.column(3)[a:b]]
                count = np.array([len(x) for x in lists])
                found = [s for t, x in zip(texts[a:b], lists, strict=True) for s in asked.scores(t, x)]
                at = np.repeat(np.arange(a, b), count)
                yield pa.RecordBatch.from_arrays([pa.array([q for x in lists for q in x], pa.int64()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(found, pa.int64())], ["q", "row", "doc", "score"])

    return keep(rows.select("row", "doc", "text", "asked").mapInArrow(score, kinds), "scored")


def _asked(questions: DataFrame, id: str, text: str) -> Iterator[list[tuple]]:
    """Blocks of (id, terms), streamed over the driver."""
    block, seen = [], 0
    for item, value in questions.select(id, text).toLocalIterator(prefetchPartitions=True):
        if own := terms((value or "").encode()):
            if block and (seen + len(own) > TERMS or len(block) == QUESTIONS):
                yield block
                block, seen = [], 0
            block.append((item, own))
            seen += len(own)
    if block:
        yield block


def _document_counts(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms."""
    asked = index.sparkSession.createDataFrame([(t,) for t in wanted], "term binary")
    rows = index.where("terms IS NOT NULL").select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))).alias("t")).select("t.term", "t.n")
    return {bytes(t): n for t, n in rows.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n")).collect()}


def search(docs: DataFrame, questions: DataFrame, index: DataFrame | None = None, k: int = K, id: str = "doc_id", text: str = "text", question_id: str = "item_id", question: str = "text") -> DataFrame:
    """(question_id, rank from 1, id, score): the k documents of highest score above 0 for each question, equal scores by id."""
    spark, index = docs.sparkSession, build(docs, text) if index is None else index
    blocks = index.where("slices IS NOT NULL")
    n, length = blocks.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s)), F.lit(0))).first()
    kinds = T.StructType([questions.schema[question_id], T.StructField("rank", T.IntegerType()), docs.schema[id], T.StructField("score", T.LongType())])
    found = [spark.createDataFrame([], kinds)]
    for block in _asked(questions, question_id, question) if n else ():
        own = Questions([q for _, q in block], _document_counts(index, sorted({t for _, q in block for t in q})), n, length)
        sent = spark.sparkContext.broadcast(own)
        rows, pairs = blocks.select("bits", "rows", "sizes", "slices"), "q long, row long, bound long"
        highest = rows.mapInArrow(_scan(sent, lambda asked: _Highest(asked, k)), pairs)
        highest = highest.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "row"))).where(F.col("at") <= k)
        least = _exact(docs, highest, sent, id, text).groupBy("q").agg(F.count("*"), F.min("score")).collect()
        reach = np.ones(len(block), np.int64)
        for q, count, score in least:
            reach[q] = max(1, score) if count == k else 1
        every = _exact(docs, rows.mapInArrow(_scan(sent, lambda _, reach=reach: _Reaching(reach)), pairs), sent, id, text).where("score > 0")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
        best = keep(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], T.StructType([T.StructField("q", T.LongType()), T.StructField(question_id, questions.schema[question_id].dataType)]))
        found.append(best.join(F.broadcast(names), "q").select(question_id, "rank", F.col("doc").alias(id), "score"))
        sent.unpersist()
    out = found[-1] if len(found) == 2 else found[0]
    for other in found[1:] if len(found) > 2 else ():
        out = out.unionByName(other)
    return out
