"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a local session (tests) has a folder of its own; on a cluster, whose
    machines would each write to their own disk, that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="sparquill-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparquill/{name}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of a query when the query ends, not when the driver next happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet, and free its shuffle files when that is done."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again, so that lost executors cost no recomputation."""
    write(df, path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(kept: DataFrame) -> None:
    """Empty the files behind what `keep` returned (and columns were added to), when all that read them is written."""
    if files := kept.inputFiles():
        kept.sparkSession.range(0).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def free(names: Iterable[str], wanted: str) -> str:
    """A column name that is none of the names, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def located(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs, and for each row its file and its place there. Rows that don't come from files are written first."""
    try:
        docs.metadataColumn("_metadata")
    except AnalysisException:
        docs = keep(docs, "rows")
    source = docs.metadataColumn("_metadata")
    return docs, source["file_path"], source["row_index"]


def placed(docs: DataFrame, name: str = "row") -> DataFrame:
    """Adds a number of each row of a table of files, made of its file and its place there. Unlike a number of the scan, it doesn't follow how a job
    splits the files, so several jobs, on whatever executors, give the same. The files' names go through the driver, as they do to plan a scan. A join
    must be written before: its rows share their files' places."""
    docs, path, index = located(docs)
    file, at, base = (free([*docs.columns, name], c) for c in ("__file", "__at", "__base"))
    rows = docs.select("*", path.alias(file), index.alias(at))
    names = sorted(r[0] for r in rows.select(file).distinct().collect())
    files = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(names)], f"`{file}` string, `{base}` long")
    return rows.join(F.broadcast(files), file).withColumn(name, F.col(base) + F.col(at)).select(*(f"`{c}`" for c in docs.columns), name)


def raw(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them. What earlier batches left in Arrow's pool goes back first: workers are
    used again by later stages."""
    pa.default_memory_pool().release_unused()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def portions(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; a longer text is a range of its own."""
    return portions_of([len(text or b"") for text in texts], most)


def portions_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """The same, from the sizes of texts."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal, disjoint ranges in order; ranges that touch are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
    at = np.flatnonzero(fresh)
    return starts[at], ends[np.concatenate((at[1:] - 1, [len(ends) - 1]))]
