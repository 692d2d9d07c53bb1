"""Ingests as versions: a run writes its tables under its own name, one small file publishes them all, and what a run that was cut short left is found and
removed.

A store is a folder: <table>/run=<run>/ for each table and run, and published/run=<run>/ with one row. A reader sees published runs only, and of a document
all rows of the newest run that holds it, so a table is never half old and half new. Every table has the document's id; `heads` has one row for each document.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS, PUBLISHED = "heads", "published"
SCHEMA = "seq long, tables array<string>, run string"


def write(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """Write a run's tables, `heads` among them. A run that is repeated overwrites its own rows; nothing of it is seen before it is published."""
    if HEADS not in tables:
        raise ValueError("a run needs heads")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/run={run}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """(seq, tables, run) of the runs that are published."""
    try:
        return spark.read.schema(SCHEMA).option("recursiveFileLookup", "false").parquet(f"{path}/{PUBLISHED}").select("seq", "tables", F.col("run").cast("string").alias("run"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SCHEMA)
        raise


def publish(spark: SparkSession, path: str, run: str, tables: list[str]) -> int:
    """Publish a run that is wholly written: its number, which is above all others. One row in one file, whose commit is the only step that readers see;
    repeated, it changes nothing. One writer publishes at a time."""
    seen = published(spark, path).agg(F.max(F.when(F.col("run") == run, F.col("seq"))).alias("own"), F.max("seq").alias("last")).first()
    if seen.own is not None:
        return seen.own
    number = (seen.last or 0) + 1
    spark.range(1).select(F.lit(number).cast("long").alias("seq"), F.array(*map(F.lit, tables)).cast("array<string>").alias("tables")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{PUBLISHED}/run={run}")
    return number


def _rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.withColumn("run", F.col("run").cast("string"))


def current(spark: SparkSession, path: str, id: str) -> DataFrame:
    """(id, run, seq): the newest published run that holds each document."""
    runs = published(spark, path).select("run", "seq")
    return _rows(spark, path, HEADS).select(id, "run").join(F.broadcast(runs), "run").groupBy(id).agg(F.max_by(F.struct("run", "seq"), "seq").alias("r")).select(id, "r.*")


def read(spark: SparkSession, path: str, name: str, id: str, keep: list[str] | None = None) -> DataFrame:
    """A table as it is published. Of `keep`'s columns of `heads` a value that the newest run lacks is that of the newest run that has one."""
    rows = _rows(spark, path, name)
    found = rows.join(current(spark, path, id).drop("seq"), [id, "run"], "left_semi")
    for column in keep or []:
        older = _rows(spark, path, name).join(F.broadcast(published(spark, path).select("run", "seq")), "run").where(F.col(column).isNotNull())
        older = older.groupBy(id).agg(F.max_by(column, "seq").alias("_older"))
        found = found.join(older, id, "left").withColumn(column, F.coalesce(column, "_older")).drop("_older")
    return found


def unpublished(spark: SparkSession, path: str, names: list[str], active: list[str] | None = None) -> DataFrame:
    """(table, run, rows) of runs that were cut short: written, not published, and not among those that still run."""
    runs = published(spark, path).select("run")
    parts = None
    for name in names:
        rows = _rows(spark, path, name).where(~F.col("run").isin(active or []))
        one = rows.join(F.broadcast(runs), "run", "left_anti").groupBy("run").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "run", "rows")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def clean_up(spark: SparkSession, path: str, names: list[str], active: list[str] | None = None) -> list[tuple[str, str, int]]:
    """Remove the rows of runs that were cut short, in every table, vectors included; what was removed. The list has a row for each table and such run."""
    gone = [tuple(r) for r in unpublished(spark, path, names, active).collect()]
    for name, run, _ in gone:
        schema = spark.read.parquet(f"{path}/{name}/run={run}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
    return gone
