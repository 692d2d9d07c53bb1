"""Readers: corpora, archives, feeds, graphs, Markdown blocks and long texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import feed_time
from ..functions.text import decode_entities, html_tables, link_id, safe_url, slug, strip_html

CORPUS = "rev long, docs array<struct<id: string, title: string, text: string>>"
ENGINE_ID = r"^[a-z0-9\-]{1,40}$"


#: How many tasks Spark lists folders and named files in; its default is one for each, up to 10,000 a folder.
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """Lists many small folders or files in a few tasks for each core, each of which lists many; only the number of tasks changes."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTERS, before)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(rev, id, title, text) of JSON corpora; files that can't be read have no rows."""
    raw = spark.read.schema(CORPUS).json(path, multiLine=True, mode="PERMISSIVE")
    return raw.select("rev", F.inline("docs"))


def index(spark: SparkSession, root: str, engine: str) -> DataFrame:
    if not re.fullmatch(ENGINE_ID, engine):
        raise ValueError(f"no engine id: {engine!r}")
    return spark.read.parquet(f"{root}/index/{engine}")


def markdown_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, title, text) of files; the id is made of the name, so that loading again replaces."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    title = F.regexp_replace(F.substring_index("value", "\n", 1), r"^#\s*", "")
    with _few_listers(spark):
        files = spark.read.text(pattern, wholetext=True)
    return files.select(F.concat(F.lit("sample-"), name).alias("id"), title.alias("title"), F.col("value").alias("text")).orderBy("id")


def archive(spark: SparkSession, path: str, schema: str, id: str = "id") -> DataFrame:
    """Lines of JSON; those that aren't are skipped, and the last line of an id holds."""
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("at"))
    rows = lines.where(F.col(f"r.{id}").isNotNull())
    return rows.groupBy(F.col(f"r.{id}").alias("_id")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def registry(feeds: DataFrame) -> DataFrame:
    """Feeds with a url, with unique slugs as ids (-2, -3 and so on in order), enabled and in a general category by default. Needs a column pos."""
    named = feeds.where(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("slug", slug(F.coalesce("id", "name")))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("pos"))
    return named.select(F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n)).alias("id"), "name", "url", F.coalesce("category", F.lit("総合")).alias("category"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def feed_articles(feeds: DataFrame, text: str = "value", source: str = "source", most: int = 40, summary: int = 320) -> DataFrame:
    """(source, id, title, link, summary, published) of RSS, RDF and Atom texts: items with a title and a web link, the first `most` of each feed."""
    bare = F.regexp_replace(F.col(text), r"<(/?)[A-Za-z0-9_\-]+:", "<$1")
    items = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    rows = feeds.select(F.col(source).alias("source"), F.posexplode(items).alias("pos", "item")).where(F.col("pos") < most)

    def field(*names: str):
        return F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit("")) for n in names))

    linked = F.coalesce(safe_url(decode_entities(field("link", "article_link"))), safe_url(decode_entities(F.regexp_extract("item", r"(?is)<link\b[^>]*href=[\"']([^\"']+)", 1))))
    text_ = strip_html(field("description", "summary", "content"))
    rows = rows.select("source", "pos", strip_html(field("title", "article_title")).alias("title"), linked.alias("link"), text_.alias("s"), feed_time(field("pubDate", "published", "updated", "date")).alias("published"))
    cut = F.when(F.length("s") > summary, F.concat(F.substring("s", 1, summary), F.lit("…"))).otherwise(F.col("s"))
    return rows.where("title <> '' AND link IS NOT NULL").select("source", "pos", link_id("link").alias("id"), "title", "link", cut.alias("summary"), "published")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, description) and edges (source, target, strength 1..10, description) of GraphML files, each under its own keys. A node that several
    files have comes once for each; of data that a node has twice the first holds; a weight that is no number is 5."""
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
    keys = read("key", "_id STRING, `_attr.name` STRING").select("file", F.col("_id").alias("key"), F.lower("`_attr.name`").alias("name")).dropDuplicates(["file", "key"])
    names = keys.where("key IS NOT NULL").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("names"))
    said = lambda name: F.filter("data", lambda e: F.try_element_at("names", e["_key"]) == name)
    value = lambda name: F.regexp_replace(F.get(said(name), 0)["_VALUE"], r'^"|"$', "")

    nodes = read("node", f"_id STRING, {data}").join(names, "file", "left")
    edges = read("edge", f"_source STRING, _target STRING, {data}").join(names, "file", "left")
    strength = F.least(F.greatest(F.bround(F.coalesce(value("weight").try_cast("double"), F.lit(5.0))), F.lit(1.0)), F.lit(10.0)).cast("int")
    of = lambda name, most: F.substring(F.coalesce(value(name), F.lit("")), 1, most)
    kind = F.coalesce(value("entity_type"), value("type"), F.lit(""))
    return (nodes.select(F.regexp_replace("_id", r'^"|"$', "").alias("id"), kind.alias("type"), of("description", 300).alias("description")),
            edges.select(F.regexp_replace("_source", r'^"|"$', "").alias("source"), F.regexp_replace("_target", r'^"|"$', "").alias("target"), strength.alias("strength"), of("description", 200).alias("description")))


def markdown_blocks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, block, type, level, content): headings, runs of table rows and runs of other lines, in order."""
    lines = docs.select(F.col(id).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    lines = lines.withColumn("level", level).withColumn("type", F.when(F.col("level") > 0, "Title").when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "Table").otherwise("Text"))
    w = Window.partitionBy("id").orderBy("pos")
    fresh = (F.col("type") == "Title") | (F.lag("type").over(w).isNull()) | (F.lag("type").over(w) != F.col("type"))
    runs = lines.withColumn("block", F.sum(fresh.cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    found = runs.groupBy("id", "block", "type").agg(F.max("level").alias("level"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content")).where("content <> ''")
    return found.withColumn("content", F.when(F.col("type") == "Title", F.regexp_replace("content", r"^#{1,6}\s+", "")).otherwise(F.col("content")))


def paragraph_blocks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, block, type, content): paragraphs; short ones with a number in front are titles."""
    parts = docs.select(F.col(id).alias("id"), F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "content")).withColumn("content", F.trim("content")).where("content <> ''")
    return parts.withColumn("type", F.when((F.length("content") < 80) & F.col("content").rlike(r"^(\d+(\.\d+)*[.)]?\s+\S|第\s*\d+\s*[章節条])"), "Title").otherwise("Text"))


def segments(docs: DataFrame, id: str, text: str, size: int = 200_000) -> DataFrame:
    """(id, segment, content): long texts cut at the last newline of a segment's last fifth, else at its end; together they are the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, parts = 0, []
                while value and at < len(value):
                    end = at + size
                    if end < len(value) and (line := value.rfind("\n", at + size * 4 // 5, end)) > 0:
                        end = line + 1
                    parts.append(value[at:end])
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(parts), batch.schema.field(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["id", "segment", "content"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(cut, f"id {docs.schema[id].dataType.simpleString()}, segment int, content string")


def tables_of_pages(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(id, place, rows, header): tables of pages; the first row is a header if its cells are all filled and different and others follow."""
    found = pages.select(F.col(id).alias("id"), F.posexplode(html_tables(html)).alias("place", "rows"))
    head = F.get("rows", 0)
    header = (F.size("rows") > 1) & F.forall(head, lambda c: c != "") & (F.size(F.array_distinct(head)) == F.size(head))
    return found.withColumn("header", header)


def collection_files(spark: SparkSession, root: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """(path, name, collection, tags): files of the wanted kinds below a folder; the collection's id is made of the folder's path, tags are sub-folders."""
    with _few_listers(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    inner = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))) + "/", "")
    parts = F.split(inner, "/")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(kind.isin(*suffixes)).select("path", F.element_at(parts, -1).alias("name"), F.lit(hashlib.md5(root.rstrip("/").encode()).hexdigest()[:10]).alias("collection"), F.slice(parts, 1, F.size(parts) - 1).alias("tags"))


def indexes(spark: SparkSession, root: str) -> DataFrame:
    """(folder, kind, units): folders with an index file: books by bookindex.json (its nodes), paged stores by docstore.json (its documents)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{bookindex,docstore}.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    book = F.col("path").endswith("/bookindex.json")
    units = F.when(book, F.json_array_length(F.get_json_object("value", "$.nodes"))).otherwise(F.json_array_length(F.get_json_object("value", "$.docs")))
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.when(book, "book").otherwise("paged").alias("kind"), F.coalesce(units, F.lit(0)).alias("units"))


def typed_blocks(docs: DataFrame, id: str, name: str, text: str) -> DataFrame:
    """(id, block, type, level, content) by a document's kind: Markdown by its own marks, all else by paragraphs."""
    marked = F.lower(F.col(name)).rlike(r"\.(md|markdown)$")
    first = markdown_blocks(docs.where(marked), id, text).select("id", "block", "type", "level", "content")
    rest = paragraph_blocks(docs.where(~F.coalesce(marked, F.lit(False))), id, text)
    return first.unionByName(rest.select("id", "block", "type", F.when(F.col("type") == "Title", 1).otherwise(0).alias("level"), "content"))


def table_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """CSV files as views to query by name."""
    for name, path in paths.items():
        spark.read.option("header", "true").option("inferSchema", "true").csv(path).createOrReplaceTempView(name)
    return list(paths)


def page_tables(pages: DataFrame, doc: str, page: str, html: str) -> DataFrame:
    """(doc, tables): the tables of a document's pages with their pages, in order."""
    rows = pages.select(doc, page, F.explode(html_tables(html)).alias("rows"))
    items = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), "rows")))
    return rows.groupBy(doc).agg(items.alias("tables"))
