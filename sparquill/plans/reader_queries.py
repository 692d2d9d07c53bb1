"""Queries of readers over files that Spark writes from the tables, and of column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import extraction
from ..sources import readers, sinks
from ..sources.tables import spread, stage_path, table
from .queries import query


@query("""SELECT 'node' AS kind, 'n' || n_nationkey AS source, CAST(NULL AS VARCHAR) AS target, 'nation' AS type, 0 AS strength, n_name AS description FROM nation
UNION ALL SELECT 'edge', 's' || s_suppkey, 'n' || s_nationkey, NULL, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 5 ELSE greatest(1, least(10, round_even(CAST(s_suppkey % 12 AS DOUBLE) + 0.5, 0))) END AS INT), 'from ' || s_name FROM supplier""")
def graph_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """A GraphML file for each nation with its suppliers as edges; values are quoted, some edges have no weight, some one out of range."""
    key = lambda id, name: f'<key id="{id}" for="all" attr.name="{name}"/>'
    head = f"<graphml>{key('k0', 'entity_type')}{key('k1', 'Description')}{key('k2', 'weight')}<graph>"
    nations, suppliers = table(spark, d, "nation"), table(spark, d, "supplier").withColumn("n_nationkey", F.col("s_nationkey"))
    line = lambda rows, place, value: rows.select(F.col("n_nationkey").alias("nation"), F.lit(place).alias("place"), value.alias("value"))
    node = F.format_string('<node id="&quot;n%d&quot;"><data key="k0">nation</data><data key="k1">"%s"</data></node>', "n_nationkey", "n_name")
    weight = F.when(F.col("s_suppkey") % 5 != 0, F.format_string('<data key="k2">%d.5</data>', F.col("s_suppkey") % 12)).otherwise("")
    edge = F.format_string('<edge source="s%d" target="n%d"><data key="k1">from %s</data>%s</edge>', "s_suppkey", "s_nationkey", "s_name", weight)
    lines = line(nations, 0, F.lit(head)).union(line(nations, 1, node)).union(line(suppliers, 2, edge)).union(line(nations, 3, F.lit("</graph></graphml>")))
    lines.repartition("nation").sortWithinPartitions("nation", "place").select("nation", "value").write.partitionBy("nation").text(path := stage_path(spark))
    found, joined = readers.graphml(spark, path)
    none = F.lit(None).cast("string")
    return found.select(F.lit("node").alias("kind"), F.col("id").alias("source"), none.alias("target"), "type", F.lit(0).alias("strength"), "description").unionByName(
        joined.select(F.lit("edge").alias("kind"), "source", "target", none.alias("type"), "strength", "description"))


def _files(spark: SparkSession, d: str, *inner: str) -> str:
    """A Markdown file for each supplier, in folders by nation and by the inner columns. What costs is the number of files, so all cores write them, not
    one task a nation."""
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.format_string("# %s\nbalance %s\n", "s_name", F.col("s_acctbal").cast("int").cast("string")).alias("value"))
    dealt = rows.repartition(2 * spark.sparkContext.defaultParallelism, "s_suppkey").select("s_nationkey", *inner, "value")
    dealt.write.option("maxRecordsPerFile", 1).partitionBy("s_nationkey", *inner).text(path := stage_path(spark))
    return path


@query("SELECT s_name AS title, '# ' || s_name || chr(10) || 'balance ' || CAST(trunc(s_acctbal) AS INT) || chr(10) AS text FROM supplier")
def markdown_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files as documents; what Spark names them is left out."""
    found = readers.markdown_files(spark, f"{_files(spark, d)}/*/*.txt")
    return found.where(F.col("id").startswith("sample-part-")).select("title", F.regexp_replace("text", r"\n+$", "\n").alias("text"))


@query("SELECT 's_nationkey=' || s_nationkey || ',s_suppkey=' || s_suppkey AS tags, 1 AS collections FROM supplier")
def collection_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of a collection with their sub-folders as tags."""
    found = readers.collection_files(spark, _files(spark, d, "s_suppkey"), ["txt", "md"])
    return found.groupBy(F.array_join("tags", ",").alias("tags")).agg(F.count_distinct("collection").cast("int").alias("collections"))


@query("SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END AS corpus_rev FROM documents")
def engine_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents saved as indexes of two engines and read by the engines' ids, with the revisions that they were made from."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), stage_path(spark)
    for engine, revision in (("odd-docs", 3), ("even-docs", 4)):
        sinks.save_index({engine: docs.where(F.col("doc_id") % 2 == 4 - revision)}, f"{path}/index", revision)
    found = readers.index(spark, path, "odd-docs").unionByName(readers.index(spark, path, "even-docs"))
    return found.select("doc_id", F.md5("text").alias("text_md5"), "corpus_rev")


@query("""SELECT o_custkey, string_agg(o_orderkey || '=Status | Day' || chr(10) || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y-%m-%d'), ';' ORDER BY o_orderkey) AS tables FROM orders GROUP BY 1""")
def page_table_cache(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order of a customer: its table, and all of a customer's tables by page, as text."""
    row = F.concat(F.lit("<table><tr><th>Status</th><th>Day</th></tr><tr><td>"), "o_orderstatus", F.lit("</td><td>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</td></tr></table>"))
    found = readers.page_tables(table(spark, d, "orders").withColumn("html", row), "o_custkey", "o_orderkey", "html")
    shown = F.transform("tables", lambda t: F.concat(t["page"].cast("string"), F.lit("="), text.table_text(t["rows"])))
    return found.select("o_custkey", F.array_join(shown, ";").alias("tables"))


@query("SELECT s_suppkey, 'supplier#' || s_suppkey AS key FROM supplier")
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of suppliers in several forms, which are one for comparison."""
    k = F.col("s_suppkey").cast("string")
    forms = [F.concat(F.lit("株式会社 Ｓupplier #"), k), F.concat(F.lit("SUPPLIER#"), k, F.lit(" Inc.")), F.concat(F.lit("supplier#"), k, F.lit(" 株式会社")), F.concat(F.lit(" Supplier# "), k)]
    return table(spark, d, "supplier").select("s_suppkey", text.entity_key(F.get(F.array(*forms), (F.col("s_suppkey") % len(forms)).cast("int"))).alias("key"))


@query("""WITH p AS (SELECT doc_id, text, 1 + doc_id * 37 % length(text) AS p FROM documents WHERE text <> ''), r AS (SELECT *, greatest(p - 110, 1) AS f, least(p + 4 + 110 - 1, length(text)) AS l FROM p)
SELECT doc_id, CASE WHEN f > 1 THEN '…' ELSE '' END || replace(substring(text, f, l - f + 1), chr(10), ' ') || CASE WHEN l < length(text) THEN '…' ELSE '' END AS excerpt FROM r""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """What stands about four characters somewhere in each text."""
    docs = table(spark, d, "documents").where("text <> ''")
    at = (1 + F.col("doc_id") * 37 % F.length("text")).cast("int")
    return docs.select("doc_id", text.excerpt("text", at, 4).alias("excerpt"))


@query("""WITH v AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * o_totalprice * power(10.0, o_orderkey % 11 - 2) AS v FROM orders)
SELECT o_orderkey, CASE WHEN abs(v) >= 1e12 THEN format('{:,.2f}', v / 1e12) || '兆' WHEN abs(v) >= 1e8 THEN format('{:,.2f}', v / 1e8) || '億' WHEN abs(v) >= 1e4 THEN format('{:,.2f}', v / 1e4) || '万' ELSE format('{:,.2f}', v) END AS shown FROM v""")
def displayed_numbers(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 11 - 2)
    return table(spark, d, "orders").select("o_orderkey", numbers.display(value).alias("shown"))


@query("""SELECT o_orderkey, '1:Order ' || o_orderkey || ':https://o.example/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',3:Customer:https://c.example/' || o_custkey END AS sources,
'Placed [S1], held .' || chr(10) AS body, CASE WHEN o_orderkey % 2 = 0 THEN 'S7' ELSE 'S7,S9' END AS removed FROM orders""")
def report_sources(spark: SparkSession, d: str) -> DataFrame:
    """Reports on orders: their numbered sources, each once, and their text without marks of sources that nobody knows."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("Placed [S1], held [S7]"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("[S9]"), F.lit(".\n"))
    first = F.concat(F.lit("[1] Order "), k, F.lit(": https://o.example/"), k)
    other = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("no source\n- [2] Again: https://o.example/"), k)).otherwise(F.concat(F.lit("* [3] Customer: https://c.example/"), F.col("o_custkey").cast("string")))
    report = F.concat(body, F.lit("## Sources\n[9] Old: https://old.example/\n## More\n\n## Sources\n"), first, F.lit("\n"), other, F.lit("\n## End\n[4] Late: https://late.example/"))
    named = F.transform(text.numbered_sources(report), lambda s: F.concat_ws(":", s["n"].cast("string"), s["title"], s["url"]))
    checked = text.unknown_citations(body, F.array(F.lit("S1"), F.lit("S2")))
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.array_join(named, ",").alias("sources"), checked["text"].alias("body"), F.array_join(checked["removed"], ",").alias("removed"))


@query("""SELECT c_custkey, c_name AS publisher, CASE WHEN c_custkey % 2 = 0 THEN 'area ' || c_nationkey END AS geography, length('発行者: ' || c_name) AS blanks,
chr(10) || 'free ' || c_custkey || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN repeat(' ', length('対象地域： area ' || c_nationkey)) ELSE 'none' END AS rest FROM customer""")
def described_sources(spark: SparkSession, d: str) -> DataFrame:
    """What labelled lines say of a source, and the text with these lines blank, so that places stay."""
    place = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("対象地域： area "), F.col("c_nationkey").cast("string"))).otherwise("none")
    page = F.concat(F.lit("発行者: "), "c_name", F.lit("\nfree "), F.col("c_custkey").cast("string"), F.lit("\n"), place)
    said, masked = text.described(page), text.mask_lines(page)
    blanks = F.length(F.regexp_extract(masked, "^( *)", 1)).cast("long")
    return table(spark, d, "customer").select("c_custkey", said["publisher"].alias("publisher"), said["geography"].alias("geography"), blanks.alias("blanks"), F.regexp_replace(masked, "^ *", "").alias("rest"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN 1.0 ELSE p_retailprice END AS v, p_size FROM part), r AS (SELECT *, min(v) OVER (PARTITION BY p_size) AS lo, max(v) OVER (PARTITION BY p_size) AS hi FROM p)
SELECT p_partkey, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (v - lo) / (hi - lo) END, 9) AS scaled FROM r""")
def scaled_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices scaled within each size; where all are equal, 0."""
    price = F.when(F.col("p_size") == 7, 1.0).otherwise(F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", F.round(numbers.min_max(price, ["p_size"], 0.0), 9).alias("scaled"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'year' ELSE '' END AS unit FROM events""")
def period_units(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("1日", "1か月", "1年間", " 2020年の1年間 ", "世紀"))), (F.col("event_id") % 6).cast("int")
    return table(spark, d, "events").select("event_id", extraction.period_unit(F.get(*names)).alias("unit"))


@query("""WITH o AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, text || ' (new)' AS text, 'new' AS lang FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, md5(text) AS text_md5, lang, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang IS NOT NULL) AS stored FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id % 3 <> 0)""")
def overridden_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which some are deleted by id, then some come anew; beside them the size of all that are stored."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "text", "lang")
    old = sinks.delete(rows, docs.where("doc_id % 7 = 0"), "doc_id")
    new = rows.where("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit(" (new)")).alias("text"), F.lit("new").alias("lang"))
    stored = sinks.within_quota(docs, "n_chars", "lang")
    both = sinks.override(old, new, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    return both.join(F.broadcast(stored), F.lit(True))


@query("""WITH l AS (SELECT doc_id, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) AS z FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL),
t AS (SELECT doc_id, z[1] AS pos, z[2] AS line, CASE WHEN regexp_matches(z[2], '^#{1,6}\\s+\\S') THEN 'Title' WHEN regexp_matches(z[2], '^\\s*\\|.*\\|\\s*$') THEN 'Table' ELSE 'Text' END AS type FROM l),
f AS (SELECT *, type = 'Title' OR coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY pos) <> type, true) AS fresh FROM t), r AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
m AS (SELECT doc_id, run, type, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS c FROM r GROUP BY ALL),
p AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\n\\s*\\n')), ' ') AS c FROM documents WHERE doc_id % 2 = 1),
b AS (SELECT doc_id, type, CASE WHEN type = 'Title' THEN regexp_replace(c, '^#{1,6}\\s+', '') ELSE c END AS c FROM m WHERE c <> '' UNION ALL SELECT doc_id, CASE WHEN length(c) < 80 AND regexp_matches(c, '^(\\d+(\\.\\d+)*[.)]?\\s+\\S|第\\s*\\d+\\s*[章節条])') THEN 'Title' ELSE 'Text' END, c FROM p WHERE c <> '')
SELECT doc_id, type, count(*) AS blocks, CAST(sum(length(c)) AS BIGINT) AS chars, min(md5(c)) AS least FROM b GROUP BY ALL""")
def typed_block_contents(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of documents by type, half of them read as Markdown, half by paragraphs, with what they hold."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("name", F.when(F.col("doc_id") % 2 == 0, "a.md").otherwise("a.txt"))
    blocks = readers.typed_blocks(docs, "doc_id", "name", "text")
    return blocks.groupBy(F.col("id").alias("doc_id"), "type").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).cast("long").alias("chars"), F.min(F.md5("content")).alias("least"))
