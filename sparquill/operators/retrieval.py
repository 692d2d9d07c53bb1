"""Lexical, vector and fused ranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.text import tokens
from ..sources.tables import spread, stage

K1, B, RRF = 1.5, 0.75, 60
#: Questions of a vector search's block, and rows that meet it together; terms of a lexical one's; documents that are scored together.
BLOCK, ROWS, ASKED, CHUNK = 2048, 512, 50_000, 2048


def frequencies(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term, in one aggregation: a document's words are sorted, and the first of each is marked."""
    words = spread(docs.select(text)).select(F.sort_array(tokens(text)).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("term"), F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("before"))).alias("t")).select("t.term", "t.before")
    first = F.when(F.col("term").eqNullSafe(F.col("before")), 0).otherwise(1)
    return pairs.where("term IS NOT NULL").groupBy("term").agg(F.sum(first).alias("df"), F.count("*").alias("cf"))


class _Asked:
    """A block of questions: distinct terms, which questions ask for each, and how many terms a question has."""

    def __init__(self, rows: list[tuple]):
        self.names, self.terms = [name for name, _ in rows], sorted({t for _, words in rows for t in words})
        self.count, at = np.array([len(words) for _, words in rows]), {t: k for k, t in enumerate(self.terms)}
        pairs = np.array(sorted((at[t], q) for q, (_, words) in enumerate(rows) for t in words), np.int64).reshape(-1, 2)
        self.questions, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, size, places of the asked terms that a document has, how often) from (id, words)."""
        known = pa.array(self.terms, pa.string())
        for batch in batches:
            words = batch.column(1)
            size = np.diff(np.asarray(words.offsets))
            place = pc.index_in(words.flatten().cast(pa.string()), value_set=known)
            here = np.asarray(pc.is_valid(place))
            key, tf = np.unique(np.repeat(np.arange(len(size)), size)[here] * len(known) + np.asarray(place.drop_null(), np.int64), return_counts=True)
            cuts = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (key % max(len(known), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *lists], ["id", "size", "place", "tf"])

    def scored(self, idf: np.ndarray, mean: float, k: int | None):
        """(q, id, score, overlap) from postings: all pairs that share a term, or those that `CHUNK` documents' k best by either may be among."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), CHUNK):
                    ids, size, place, tf = batch.slice(start, CHUNK).columns
                    row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(place.offsets)))
                    at, tf = np.asarray(place.flatten(), np.int64), np.asarray(tf.flatten(), float)
                    part = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.asarray(size)[row] / mean))
                    times = self.first[at + 1] - self.first[at]
                    asked = self.questions[np.repeat(self.first[at + 1] - np.cumsum(times), times) + np.arange(int(times.sum()))]
                    cell, shape = np.repeat(row, times) * len(self.count) + asked, (len(ids), len(self.count))
                    total = np.round(np.bincount(cell, np.repeat(part, times), len(ids) * len(self.count)), 6).reshape(shape)
                    share = np.bincount(cell, minlength=len(ids) * len(self.count)).reshape(shape) / self.count
                    kept = total > 0
                    if k is not None and len(ids) > k:
                        kept &= (total >= -np.partition(-total, k - 1, axis=0)[k - 1]) | (share >= -np.partition(-share, k - 1, axis=0)[k - 1])
                    doc, q = np.nonzero(kept)
                    yield pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(doc)), pa.array(total[doc, q]), pa.array(share[doc, q])], ["q", "id", "score", "overlap"])

        return score


def _blocks(questions: DataFrame, id: str, text: str) -> Iterator[_Asked]:
    """Questions with their distinct terms, streamed over the driver and cut into blocks of at most `ASKED` terms, counted in each question."""
    block, seen = [], 0
    for name, words in questions.select(F.col(id), F.array_distinct(tokens(text))).toLocalIterator(prefetchPartitions=True):
        if words:
            if block and seen + len(words) > ASKED:
                yield _Asked(block)
                block, seen = [], 0
            block.append((name, words))
            seen += len(words)
    if block:
        yield _Asked(block)


def bm25(docs: DataFrame, questions: DataFrame, id: str = "doc_id", text: str = "text", question_id: str = "item_id", question: str = "text", k: int | None = None) -> DataFrame:
    """(question, id, score, overlap): BM25 over distinct question terms, and the share of them that the document has; positive scores only. With k, at
    least the rows that are among a question's k best by either, so that pairs don't leave their task.

    Questions go in blocks of bounded size. For a block, texts are tokenised once; what is written is one row a document with the asked terms it has, from
    which document frequencies are added up and all of the block's questions are scored where the row is. No pair is shuffled.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType
    words = spread(docs.select(F.col(id).alias("id"), F.col(text).alias("text"))).select("id", tokens("text").alias("w"))
    rows = StructType([StructField("id", kind), StructField("size", LongType()), StructField("place", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])
    pairs = StructType([StructField("q", LongType()), StructField("id", kind), StructField("score", DoubleType()), StructField("overlap", DoubleType())])
    name = StructField("question", questions.schema[question_id].dataType)
    found = spark.createDataFrame([], StructType([name, *pairs.fields[1:]]))
    for n_block, asked in enumerate(_blocks(questions, question_id, question)):
        own = stage(words.mapInArrow(lambda batches, asked=asked: asked.postings(batches), rows))
        n, mean = own.agg(F.count("*"), F.avg("size")).first()
        df = np.zeros(len(asked.terms))
        for place, count in own.select(F.explode("place").alias("place")).groupBy("place").count().collect():
            df[place] = count
        scored = own.mapInArrow(asked.scored(np.log(1 + (n - df + 0.5) / (df + 0.5)), mean or 1.0, k), pairs)
        names = spark.createDataFrame(list(enumerate(asked.names)), StructType([pairs.fields[0], name]))
        block = scored.join(F.broadcast(names), "q").select("question", "id", "score", "overlap")
        found = found.unionByName(block) if n_block else block
    return found


def top(ranked: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def fuse(lists: list[DataFrame], by: str = "question", id: str = "id") -> DataFrame:
    """(question, id, rrf) from lists (question, id, rank from 1): the sum of 1 / (60 + rank)."""
    every = lists[0].select(by, id, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(by, id, "rank"))
    return every.groupBy(by, id).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("rrf"))


def hybrid(found: DataFrame) -> DataFrame:
    """(question, id, rank, rrf) of the six best of BM25's and overlap's first twelve. The scores are written once and read for both lists."""
    found = stage(found)
    lists = [top(found, ["question"], [F.desc(c), F.asc("id")], 12) for c in ("score", "overlap")]
    return top(fuse(lists), ["question"], [F.desc("rrf"), F.asc("id")], 6)


def both_ways(vectors: DataFrame, lexical: DataFrame, each: int = 12, k: int = 6) -> DataFrame:
    """(question, id, rank, rrf): the k best of a vector list (question, id, similarity) and a lexical list (question, id, score), fused by their ranks. Each
    list gives its `each` best rows that are above 0; a question that has one list only is ranked by it."""
    lists = [top(rows.where(F.col(c) > 0), ["question"], [F.desc(c), F.asc("id")], each) for rows, c in ((vectors, "similarity"), (lexical, "score"))]
    return top(fuse(lists), ["question"], [F.desc("rrf"), F.asc("id")], k)


def vector_top(rows: DataFrame, questions: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """(question, id, similarity, rank): the k most similar other rows of each question by cosine, ties by id. Where questions are named apart from rows,
    `itself` lets a row of the same id in.

    Questions are numbered and cut into blocks of `BLOCK`; each block is a broadcast of bounded size that one scan of the rows multiplies with, `ROWS`
    at a time, and a task keeps k rows for each question. A set of questions that grows with the rows belongs to an index, not here: the work is one product for each pair.
    """
    context, sent = rows.sparkSession.sparkContext, []
    asked = questions.select(F.col(id).cast("long"), vector).where(F.col(vector).isNotNull()).toLocalIterator()
    while block := list(islice(asked, BLOCK)):
        sent.append(context.broadcast((np.array([r[0] for r in block], np.int64), _unit([r[1] for r in block]))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for batch in (batch.slice(start, ROWS) for batch in batches for start in range(0, len(batch), ROWS)):
            ids, own = batch.column(0).to_numpy(zero_copy_only=False), _unit(batch.column(1).to_pylist())
            for n, block in enumerate(sent):
                names, asked = block.value
                if own.shape[1] != asked.shape[1]:
                    continue
                score = np.round(asked @ own.T, 6)
                if not itself:
                    score[names[:, None] == ids[None]] = -np.inf
                held, at = best.get(n), (np.arange(len(names)), np.arange(len(ids)))
                if full := held is not None and held[1].shape[1] == k:  # only what isn't below a question's last goes on
                    near = score >= held[1][:, -1:]
                    at = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                score = score[np.ix_(*at)]
                every = np.broadcast_to(ids[at[1]], score.shape)
                if held is not None:
                    every, score = np.concatenate((held[0][at[0]], every), axis=1), np.concatenate((held[1][at[0]], score), axis=1)
                order = np.lexsort((every, -score), axis=1)[:, :k]
                every, score = np.take_along_axis(every, order, 1), np.take_along_axis(score, order, 1)
                if full:
                    held[0][at[0]], held[1][at[0]] = every, score
                else:
                    best[n] = every, score
        for n, (every, score) in best.items():
            kept = np.isfinite(score)
            asked_id = np.broadcast_to(sent[n].value[0][:, None], kept.shape)
            yield pa.RecordBatch.from_arrays([pa.array(asked_id[kept]), pa.array(every[kept]), pa.array(score[kept])], ["question", "id", "similarity"])

    found = spread(rows.select(F.col(id).cast("long"), vector).where(F.col(vector).isNotNull())).mapInArrow(scan, "question long, id long, similarity double")
    return top(found, ["question"], [F.desc("similarity"), F.asc("id")], k)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, float).reshape(len(vectors), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def guaranteed(rows: DataFrame, source: str, when: str, id: str, each: int = 8, total: int = 600) -> DataFrame:
    """The newest `each` rows of every source, filled up by recency to `total`; if guarantees alone are more, sources take turns.

    Only rows that can be in the result are ordered together: the newest of each source, and the newest `total` of all.
    """
    by_time = [F.desc_nulls_last(when), F.asc(id)]
    first = top(rows, [source], by_time, each).withColumnRenamed("rank", "turn")
    newest = rows.orderBy(*by_time).limit(total).withColumn("turn", F.lit(each + 1))
    every = first.unionByName(newest.join(first.select(id), id, "left_anti"))
    crowded = F.lit(first.count() > total)
    return every.orderBy((F.col("turn") > each).asc(), F.when(crowded, F.col("turn")).asc(), F.when(crowded, F.col(source)).asc(), *by_time).limit(total)


def even_sample(rows: DataFrame, section: str, order: str, budget: int) -> DataFrame:
    """Sections take turns, each in its own order, until the budget is spent."""
    turn = F.row_number().over(Window.partitionBy(section).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= budget).orderBy("turn", section).limit(budget)


def fill_forward(rows: DataFrame, by: str, order: str, value: Column, default: str) -> Column:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default))


def document_scores(chunks: DataFrame, doc: str, score: str, order: str, each: int, how: str = "mean") -> DataFrame:
    """(doc, n_chunks, score): the mean or maximum of a document's best chunks."""
    best = top(chunks, [doc], [F.desc(score), F.asc(order)], each)
    counts = chunks.groupBy(doc).agg(F.count("*").alias("n_chunks"))
    value = (F.avg if how == "mean" else F.max)(score)
    return best.groupBy(doc).agg(F.round(value, 6).alias("score")).join(counts, doc)
