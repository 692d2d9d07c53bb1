"""Tables by name, and stages that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset a local session has a folder of its own; on a cluster, whose machines
    would each write to their own disk, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "local").partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sparquill-stage-"))
        folder = _own[0]
    return f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts the lineage."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than the session has cores, dealt to all cores, for work that costs more than moving the rows; of more files, as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a number from 1 in a total order. Rows are sorted by range in many tasks; only the counts of these ranges are added up in one."""
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")
