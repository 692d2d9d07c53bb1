"""Writers and updates: each computes the new state of a table as a DataFrame, which one write commits as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_guard
from .tables import numbered


def upsert(old: DataFrame, new: DataFrame, id: str, order: str) -> DataFrame:
    """Rows of both by id: the later holds (new before old, then by order), in the place where the id first stood (column pos)."""
    every = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    values = F.struct(*(c for c in every.columns if c not in (id, "_batch")))
    found = every.groupBy(id).agg(F.max_by(values, F.struct("_batch", order)).alias("r"), F.min(F.struct("_batch", order)).alias("_first"))
    return found.select(id, "r.*", F.struct("_first._batch", F.col(f"_first.{order}")).alias("pos"))


def delete(rows: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    return rows.join(gone.select(id), id, "left_anti")


def unseen(archive: DataFrame, new: DataFrame, id: str) -> DataFrame:
    """New rows whose id the archive doesn't have; of repeated ids, one."""
    return new.dropDuplicates([id]).join(archive.select(id), id, "left_anti")


def capped(rows: DataFrame, when: list[Column], cap: int, id: str) -> DataFrame:
    """The newest rows up to a cap; a time that is missing or zero falls to the next one given."""
    time = F.coalesce(*(F.nullif(w, F.lit(0)) for w in when), F.lit(0))
    return rows.orderBy(time.desc(), F.asc(id)).limit(cap)


def override(old: DataFrame, new: DataFrame, id: str) -> DataFrame:
    """Both, new rows in place of old ones of the same id."""
    return new.unionByName(old.join(new.select(id), id, "left_anti"))


def sequence(events: DataFrame, last: DataFrame, by: str, arrival: list[str]) -> DataFrame:
    """Events with seq: numbers that go on from the last one of their group (table by, last)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*arrival))
    return events.join(last, by, "left").withColumn("seq", n + F.coalesce("last", F.lit(0))).drop("last")


def expired(events: DataFrame, jobs: DataFrame, job: str, finished: Column, before: Column) -> DataFrame:
    """Events older than a time whose job is finished."""
    return events.where(before).join(jobs.where(finished).select(job), job, "left_semi")


def newest(rows: DataFrame, by: str | None, order: list[Column], size: int) -> DataFrame:
    """A history that holds the newest rows (of each group)."""
    if by is None:
        return rows.orderBy(*order).limit(size)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= size).drop("_n")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV in which no text cell can run as a formula."""
    rows.select(*(csv_guard(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes)).write.option("header", True).csv(path)


def within_quota(artifacts: DataFrame, size: str, path: str) -> Column:
    return artifacts.where(F.col(path).isNotNull()).agg(F.coalesce(F.sum(size), F.lit(0)).alias("stored"))


def replace_projects(new: DataFrame, path: str, project: str) -> None:
    """Save projects: each one's rows go and its new ones come; other projects' stay. The table is partitioned by project and overwritten partition by
    partition, so a save that is run again changes nothing, and one that was cut short leaves no half."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(project).parquet(path)


def save_index(tables: dict[str, DataFrame], path: str, revision: int) -> None:
    """An index as Parquet tables side by side, each with the revision of the corpus that it was made from."""
    for name, rows in tables.items():
        rows.withColumn("corpus_rev", F.lit(revision)).write.mode("overwrite").parquet(f"{path}/{name}")


def stale(index: DataFrame, revision: int) -> DataFrame:
    """Rows of an index that was made from another revision."""
    return index.where(F.col("corpus_rev") != revision)


def tree_signature(tree: DataFrame, doc: str, node: str, kind: str, text: str) -> DataFrame:
    """(doc, signature) of an outline: a checkpoint that was made for another signature is discarded."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(node).alias("n"), F.concat_ws(":", node, kind, F.length(text)).alias("s"))))
    return tree.groupBy(doc).agg(F.substring(F.md5(F.array_join(F.transform(parts, lambda p: p["s"]), "|")), 1, 12).alias("signature"))


def open_nodes(nodes: DataFrame, done: DataFrame, signatures: DataFrame, doc: str, node: str) -> DataFrame:
    """Nodes that are still to be read: those without a good result (doc, node, signature, status) under the current signature."""
    good = done.where("status = 'ok'").join(signatures, [doc, "signature"], "left_semi")
    return nodes.join(good, [doc, node], "left_anti")


def added(rows: DataFrame, known: DataFrame, id: str, title: str, text: str, order: str) -> DataFrame:
    """New corpus rows: without empty texts; a title is the first line (40 characters) by default and 120 at most, a text 400,000; a row without an id
    gets d and the next free number."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    first = F.substring(F.trim(F.substring_index(t, "\n", 1)), 1, 40)
    kept = rows.where(t != "").select(id, order, F.substring(F.coalesce(F.nullif(F.trim(title), F.lit("")), first), 1, 120).alias(title), F.substring(t, 1, 400_000).alias(text))
    last = known.select(F.coalesce(F.max(F.regexp_extract(id, r"^d(\d+)$", 1).try_cast("long")), F.lit(0)).alias("_last"))
    free = numbered(kept.where(F.col(id).isNull()), [order], "_k").join(F.broadcast(last))  # one row
    named = free.withColumn(id, F.concat(F.lit("d"), (F.col("_last") + F.col("_k")).cast("string"))).select(kept.columns)
    return kept.where(F.col(id).isNotNull()).unionByName(named).drop(order)


def set_enabled(feeds: DataFrame, id: str, chosen: list[str], value: bool) -> tuple[DataFrame, Column]:
    """Feeds with the chosen ones switched, and a column over the feeds as they were that says which change. A feed that doesn't say is enabled."""
    hit, now = F.coalesce(F.col(id).isin(*chosen), F.lit(False)), F.coalesce(F.col("enabled"), F.lit(True))
    return feeds.withColumn("enabled", F.when(hit, F.lit(value)).otherwise(now)), hit & (now != F.lit(value))


def moved(members: DataFrame, collection: str, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan of a move of documents (doc_id, path) to new places of a collection: members (doc_id, collection, tags) that leave, and documents that
    then are in no collection, with nobody's tags."""
    there = members.where(F.col("collection") == collection)
    leaving = there.join(arriving.select("doc_id"), "doc_id", "left_anti")
    rest = members.join(leaving.select("doc_id", "collection"), ["doc_id", "collection"], "left_anti")
    return leaving, leaving.select("doc_id").distinct().join(rest, "doc_id", "left_anti")


def tag_union(members: DataFrame) -> DataFrame:
    """(doc_id, tags): all tags of a document's memberships."""
    return members.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def job_report(jobs: DataFrame, parts: dict[str, tuple[DataFrame, str, list[str]]], job: str) -> DataFrame:
    """(job, json): a job with its results, claims and sources nested, in order, as JSON. parts: name to (rows, order, columns)."""
    for name, (rows, order, columns) in parts.items():
        items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_c"))))
        jobs = jobs.join(rows.groupBy(job).agg(F.transform(items, lambda r: r["_c"]).alias(name)), job, "left")
    return jobs.select(job, F.to_json(F.struct(*jobs.columns)).alias("json"))


def markdown_report(rows: DataFrame, by: str, order: str, title: str, body: str) -> DataFrame:
    """(by, markdown): sections with their titles, in order."""
    section = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), section.alias("s"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(items, lambda r: r["s"]), "\n\n").alias("markdown"))


def without_project(tables: dict[str, DataFrame], gone: DataFrame, project: str) -> dict[str, DataFrame]:
    """All tables without the rows of projects that are deleted."""
    return {name: rows.join(gone.select(project).distinct(), project, "left_anti") for name, rows in tables.items()}
