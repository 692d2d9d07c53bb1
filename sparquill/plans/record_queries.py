"""Queries of readers, writers, streams and column functions: data that Spark derives from the tables goes through files and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedded, numbers, text
from ..operators import simulation
from ..sources import readers, sinks
from ..sources.tables import stage_path, table
from ..streaming import events as ev
from .queries import query


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, md5(text) AS text_md5, 7 AS rev FROM documents WHERE text IS NOT NULL""")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each source's documents as a JSON corpus, read back."""
    doc = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    docs = table(spark, d, "documents").where("text IS NOT NULL").groupBy("source").agg(F.lit(7).cast("long").alias("rev"), F.collect_list(doc).alias("docs")).drop("source")
    docs.write.json(path := stage_path(spark))
    lines = spark.read.schema(readers.CORPUS).json(path)
    return lines.select("rev", F.inline("docs")).select("id", "title", F.md5("text").alias("text_md5"), F.col("rev").cast("int").alias("rev"))


@query("""SELECT event_id AS id, event_type AS kind, round(value, 6) AS value FROM events""")
def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of JSON among others that aren't; repeated ids hold once."""
    rows = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")).alias("value"))
    rows.union(rows.limit(50)).union(rows.limit(20).select(F.lit("{broken").alias("value"))).write.text(path := stage_path(spark))
    return readers.archive(spark, path, "id long, kind string, value double").select("id", "kind", F.round("value", 6).alias("value"))


@query("""SELECT conv_id AS source, 'Turn ' || turn AS title, md5('http://x.example/' || conv_id || '/' || turn)[1:12] AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 4""")
def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as RSS feeds; the first four turns are read."""
    item = F.concat(F.lit("<item><title>Turn "), F.col("turn").cast("string"), F.lit("</title><link>http://x.example/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("</link></item>"))
    feeds = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), "").alias("items"))
    feeds = feeds.select("source", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value"))
    return readers.feed_articles(feeds.where(text.looks_like_feed("value")), most=4).select("source", "title", "id")


@query("""WITH s AS (SELECT n_nationkey, lower(n_name[1:2]) AS slug, row_number() OVER (PARTITION BY lower(n_name[1:2]) ORDER BY n_nationkey) AS k FROM nation) SELECT CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id, 'http://n/' || n_nationkey AS url, true AS enabled FROM s""")
def feed_registry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    feeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lit(None).cast("string").alias("id"), F.substring("n_name", 1, 2).alias("name"), F.concat(F.lit("http://n/"), k).alias("url"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("boolean").alias("enabled"))
    return readers.registry(feeds).select("id", "url", "enabled")


@query("""SELECT doc_id AS id, md5(text) AS text_md5 FROM documents WHERE text <> ''""")
def segment_scan(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut into segments of 500 characters and put together again."""
    parts = readers.segments(table(spark, d, "documents"), "doc_id", "text", 500)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "content"))), lambda s: s["content"]), "")
    return parts.groupBy("id").agg(F.md5(whole).alias("text_md5"))


@query("""SELECT n_regionkey AS id, true AS header, count(*) + 1 AS n, min(n_name) AS first FROM nation GROUP BY 1""")
def html_table_scan(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td> "), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    found = readers.tables_of_pages(pages.withColumn("html", F.concat(F.lit("<table><tr><th>Nation</th><th>Key</th></tr>"), "rows", F.lit("</table>"))), "n_regionkey", "html")
    return found.select("id", "header", F.size("rows").cast("long").alias("n"), F.col("rows")[1][0].alias("first"))


@query("""SELECT doc_id % 2 = 0 AS marked, count(*) AS docs FROM documents WHERE text <> '' GROUP BY 1""")
def typed_block_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''").withColumn("name", F.when(F.col("doc_id") % 2 == 0, "a.md").otherwise("a.txt"))
    blocks = readers.typed_blocks(docs, "doc_id", "name", "text")
    return docs.join(blocks.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy((F.col("doc_id") % 2 == 0).alias("marked")).agg(F.count("*").alias("docs"))


@query("""SELECT n_regionkey, count(*) AS n, min(n_name) AS first, round(avg(n_nationkey), 4) AS mean FROM nation GROUP BY 1""")
def table_load(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as CSV, loaded as a view and asked in SQL."""
    table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name").write.option("header", "true").csv(path := stage_path(spark))
    view = readers.table_views(spark, {"loaded_nations": path})[0]
    return spark.sql(f"SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n, min(n_name) AS first, round(avg(n_nationkey), 4) AS mean FROM {view} GROUP BY n_regionkey")


@query("""SELECT event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_id > 100 GROUP BY 1""")
def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """The log replayed from a cursor as a stream, twice: the second call finds nothing new."""
    path, log = stage_path(spark), stage_path(spark)
    for _ in range(2):
        ev.replayed(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, "event_id", 100, path, log)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def _landed(docs: DataFrame) -> DataFrame:
    """Dealt to as many files as the table is read in parts, four at least, so that a file doesn't grow with the table."""
    return docs.repartition(max(4, docs.rdd.getNumPartitions()))


@query("""SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    path, source = stage_path(spark), stage_path(spark)
    _landed(table(spark, d, "documents")).write.parquet(source)
    rows = spark.readStream.schema(table(spark, d, "documents").schema).option("maxFilesPerTrigger", 2).parquet(source)
    ev.ingested(rows, path, stage_path(spark))
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""SELECT o_custkey % 5 AS project, count(*) AS n, round(sum(CASE WHEN o_custkey % 5 = 2 THEN 1.0 ELSE o_totalprice END), 2) AS total FROM orders WHERE o_custkey % 5 <> 2 OR o_orderstatus = 'F' GROUP BY 1""")
def project_save(spark: SparkSession, d: str) -> DataFrame:
    """Orders by project; one project is saved again with other rows, which replace its old ones."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("project"), "o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.replace_projects(rows, path := stage_path(spark), "project")
    sinks.replace_projects(rows.where("project = 2 AND o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(1.0)), path, "project")
    return spark.read.parquet(path).groupBy(F.col("project").cast("long").alias("project")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def project_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("project"))
    tables = {"s": table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project")), "c": table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("project"))}
    kept = sinks.without_project(tables, gone, "project")
    return kept["s"].unionByName(kept["c"]).select("s_suppkey")


@query("""SELECT 'nodes' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'edges', count(*) FROM region""")
def index_save(spark: SparkSession, d: str) -> DataFrame:
    """An index of two tables saved under a revision and loaded; only rows of another revision would be stale."""
    sinks.save_index({"nodes": table(spark, d, "nation"), "edges": table(spark, d, "region")}, path := stage_path(spark), 3)
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    found = nodes.join(sinks.stale(nodes, 3).select("n_nationkey"), "n_nationkey", "left_anti").select(F.lit("nodes").alias("kind")).union(edges.select(F.lit("edges")))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, md5(string_agg(event_id || ':' || event_type || ':' || length(props), '|' ORDER BY event_id))[1:12] AS signature FROM events GROUP BY 1)
SELECT user_id, event_id FROM events JOIN s USING (user_id) WHERE NOT (event_id % 3 = 0 AND user_id % 2 = 0)""")
def resumable_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as blocks of users' outlines: a third is done, but for every other user under an old signature."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    now = sinks.tree_signature(rows, "user_id", "event_id", "event_type", "props")
    done = rows.where("event_id % 3 = 0").join(now, "user_id").select("user_id", "event_id", F.when(F.col("user_id") % 2 == 0, F.col("signature")).otherwise("old").alias("signature"), F.lit("ok").alias("status"))
    return sinks.open_nodes(rows.select("user_id", "event_id"), done, now, "user_id", "event_id")


@query("""WITH r AS (SELECT doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ') AS t FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM r WHERE t <> '' AND doc_id % 2 = 1)
SELECT 'd' || (5 + n) AS id, trim(split_part(t, chr(10), 1))[1:40] AS title, length(t) AS chars FROM k UNION ALL SELECT 'x' || doc_id, trim(split_part(t, chr(10), 1))[1:40], length(t) FROM r WHERE t <> '' AND doc_id % 2 = 0""")
def corpus_add(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("id"), F.lit("").alias("title"), "text", F.col("doc_id").alias("at"))
    known = table(spark, d, "nation").where("n_nationkey <= 5").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"))
    return sinks.added(rows, known, "id", "title", "text", "at").select("id", "title", F.length("text").cast("long").alias("chars"))


@query("""SELECT n_nationkey, n_nationkey % 3 = 0 AND n_name <> 'x' AS enabled, (SELECT count(*) FROM nation WHERE n_nationkey IN (1, 2, 3) AND n_nationkey % 3 = 0) AS changed FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)) UNION ALL SELECT n_nationkey, false, (SELECT count(*) FROM nation WHERE n_nationkey IN (1, 2, 3) AND n_nationkey % 3 = 0) FROM nation WHERE n_nationkey IN (1, 2, 3)""")
def registry_update(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), (F.col("n_nationkey") % 3 == 0).alias("enabled"))
    after, change = sinks.set_enabled(feeds, "id", ["1", "2", "3"], False)
    changed = feeds.where(change).agg(F.count("*").alias("changed"))
    return after.join(F.broadcast(changed)).select(F.col("id").cast("long").alias("n_nationkey"), "enabled", "changed")


@query("""WITH m AS (SELECT doc_id, lang AS collection, source FROM documents UNION ALL SELECT doc_id, 'all', source FROM documents WHERE doc_id % 2 = 0), l AS (SELECT doc_id FROM m WHERE collection = 'en' AND doc_id % 5 <> 0)
SELECT (SELECT count(*) FROM l) AS leaving, (SELECT count(DISTINCT doc_id) FROM l WHERE doc_id % 2 = 1) AS orphaned, (SELECT count(DISTINCT doc_id) FROM m) AS tagged""")
def location_move(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("collection"), F.array("source").alias("tags"))
    members = docs.unionByName(docs.where("doc_id % 2 = 0").withColumn("collection", F.lit("all")))
    leaving, orphaned = sinks.moved(members, "en", docs.where("doc_id % 5 = 0"))
    counts = [leaving.agg(F.count("*").alias("leaving")), orphaned.agg(F.count("*").alias("orphaned")), sinks.tag_union(members).agg(F.count("*").alias("tagged"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each


@query("""SELECT r_regionkey, md5('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","nations":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}') AS json_md5 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def job_report(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    jobs = table(spark, d, "region").select("r_regionkey", "r_name")
    return sinks.job_report(jobs, {"nations": (nations, "n_nationkey", ["n_nationkey", "n_name"])}, "r_regionkey").select("r_regionkey", F.md5("json").alias("json_md5"))


@query("""SELECT conv_id, md5(string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_report(table(spark, d, "conversations").where("text IS NOT NULL"), "conv_id", "turn", "role", "text").select("conv_id", F.md5("markdown").alias("markdown_md5"))


@query(r"""SELECT conv_id, turn, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[。.!?！？]+$', ''))[1:80] AS claim, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS relation_md5,
regexp_replace(regexp_replace(lower(role || ' ' || turn), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, length(regexp_replace(text, '[\x{200B}-\x{200F}\x{FEFF}]|[\x00-\x08\x0B-\x1F\x7F]', '', 'g')) AS scrubbed,
CASE WHEN length(text) <= 90 THEN text ELSE text[1:30] || ' … ' || text[CAST(floor(length(text) / 2) AS INT) - 14:CAST(floor(length(text) / 2) AS INT) + 15] || ' … ' || text[-30:] END AS representative FROM conversations WHERE text IS NOT NULL""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("text IS NOT NULL")
    return rows.select("conv_id", "turn", F.substring(text.claim_text("text"), 1, 80).alias("claim"), F.md5(text.relation_key("text")).alias("relation_md5"), text.slug(F.concat_ws(" ", "role", "turn")).alias("slug"), F.length(text.scrub("text")).cast("long").alias("scrubbed"), text.representative("text", 90).alias("representative"))


@query(r"""SELECT conv_id, turn, trim(role || ' says') AS answer, trim(coalesce(text, '')) || CASE WHEN trim(coalesce(text, '')) <> '' THEN chr(10) ELSE '' END || 't' || turn AS thought FROM conversations WHERE NOT contains(coalesce(text, ''), '<')""")
def answers_and_thoughts(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("<think>"), F.coalesce("text", F.lit("")), F.lit("</think>"), "role", F.lit(" says<think>t"), F.col("turn").cast("string"))
    found = text.answer_and_thought(said)
    return table(spark, d, "conversations").where("NOT contains(coalesce(text, ''), '<')").select("conv_id", "turn", found["answer"].alias("answer"), found["thought"].alias("thought"))


@query(r"""WITH u AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'ftp://x/y' WHEN 2 THEN 'http://10.0.0.1/x' WHEN 3 THEN 'http://me@site.example/' WHEN 4 THEN 'http://localhost/' ELSE regexp_replace(url, '[?#].*$', '') || '.pdf' END AS u FROM pages)
SELECT page_id, CASE WHEN page_id % 6 = 1 THEN NULL ELSE trim(u) END AS safe, page_id % 6 IN (0, 5) AS public, CASE WHEN page_id % 6 = 5 THEN 'pdf' ELSE 'unknown' END AS kind, CASE WHEN page_id % 6 = 1 THEN 0 ELSE 1 END AS cited FROM u""")
def url_functions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 6
    u = F.when(k == 1, "ftp://x/y").when(k == 2, "http://10.0.0.1/x").when(k == 3, "http://me@site.example/").when(k == 4, "http://localhost/").when(k == 5, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".pdf"))).otherwise(F.col("url"))
    rows = table(spark, d, "pages").select("page_id", u.alias("u"))
    cited = F.size(text.citations(F.concat(F.lit("see "), F.col("u"), F.lit(". And "), F.col("u"))))
    return rows.select("page_id", text.safe_url("u").alias("safe"), text.public_url("u").alias("public"), text.document_type(F.lit(""), "u").alias("kind"), cited.alias("cited"))


@query(r"""SELECT p_partkey, 2018 + 1 + p_partkey % 5 AS year, (p_size * 10000 + p_partkey % 9 * 1000 + 0.0) AS amount, CASE WHEN p_size % 3 = 0 THEN 7 ELSE least(10, p_size) END AS score, CASE WHEN p_size > 10 THEN least(p_size, 20) - 10 ELSE 0 END / 10.0 AS overlap, least(2 * pow(2, p_size % 8), 60) AS backoff,
CAST('0x' || sha256(p_brand || '|' || p_partkey || '|9')[1:8] AS BIGINT) % 1000 AS hashed FROM part WHERE p_size > 0""")
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    era = F.concat(F.lit("令和"), (1 + k % 5).cast("string"), F.lit("年"))
    amount = F.concat(size.cast("string"), F.lit("万"), F.when(k % 9 > 0, F.concat((k % 9).cast("string"), F.lit("千"))).otherwise(""))
    score = numbers.lenient_score(F.when(size % 3 == 0, "高い").otherwise(F.concat(F.lit("score "), size.cast("string"))), 0, 10, 5)
    shared = numbers.overlap(F.lit(0.0), size.cast("double"), F.lit(10.0), F.lit(20.0))
    by_shorter = F.when(shared > 0, shared * F.least(size.cast("double"), F.lit(10.0)) / 10).otherwise(0.0)
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", numbers.year(era).alias("year"), numbers.japanese_number(amount).alias("amount"), score.alias("score"), by_shorter.alias("overlap"), numbers.backoff(size % 8).alias("backoff"), numbers.hash_number([F.col("p_brand"), k.cast("string")], 9, 1000).alias("hashed"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity, round(a.e[1] / sqrt(list_sum(list_transform(a.e, lambda x: x * x))), 6) AS first FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(numbers.cosine("embedding", "other"), 6).alias("similarity"), F.round(numbers.unit("embedding")[0], 6).alias("first"))


@query(r"""SELECT conv_id, turn, '{"turn":' || turn || '}' AS last FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '[\[{]')""")
def last_objects(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(' {"a":[1]} then {"turn":'), F.col("turn").cast("string"), F.lit("} done"))
    return table(spark, d, "conversations").where(r"NOT coalesce(text, '') RLIKE '[\\[{]'").select("conv_id", "turn", F.regexp_replace(embedded.last_json(said), " ", "").alias("last"))


@query()
def copula_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws with a rank correlation for each part: uniform, and alike in order."""
    found = simulation.correlated(["a", "b"], np.array([[1.0, 0.8], [0.8, 1.0]]), 5, F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", *(F.round(v, 9).alias(k) for k, v in found.items()))
