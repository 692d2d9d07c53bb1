"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token file.

Each stage works on all rows that its predecessor kept, and its decisions take effect. All but the last return the columns of documents, and other
columns that docs has, whatever their names. A stage gives the same rows in every run and whatever files they lie in; its files are emptied when the next
stage is written. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import decontaminate, mixing, quality, simhash, tokens
from sparquill.llm.common import documents, free, keep, new_path, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the trees go, among them null and empty texts; repeated rows are judged alike, and ids don't matter."""
    trees, judged = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free(docs.columns, "_quality")
    return docs.withColumn(judged, quality.verdict("text", trees)).where(F.col(judged)["kept"]).drop(judged)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one of least id (a row without an id only where none has one), the first in its files
    where several rows have that id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay, and so does everything if no item has a word."""
    found, hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), free(docs.columns, "_hits")
    return docs.withColumn(hits, found).where(F.size(F.col(hits)["ranges"]) == 0).drop(hits)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Texts without words are never taken; null sources are one source, the last; repeated rows are drawn one by
    one."""
    return mixing.mixed(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and return what it holds: doc_id, start, n_tokens, ids_crc32. Each row of docs is a document; null ids come first, and a null
    text has the end id alone."""
    tokens.write(docs, path := new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(spark, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", source_mix), ("tokens", token_file)]

#: The trees, the flight of the mix and the tokenizer are not SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, read = keep(stage(spark, docs, sf_dir), name), before
        before = docs
        if read is not None:
            release(read)
    out = STAGES[-1][1](spark, docs, sf_dir)  # the token file is written; what is returned reads it alone
    release(docs)
    return out
