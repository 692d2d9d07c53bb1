"""Registered queries of the operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embedded, numbers, text
from ..functions.chunks import chunked
from ..operators import clusters, evidence, graph, packing, retrieval, simulation, statistics, trees
from ..sources import readers, sinks
from ..sources.tables import stage_path, table
from ..streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def token_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.frequencies(table(spark, d, "documents"), "doc_id", "text").select("term", F.col("df").cast("long"), "cf")


BM25 = f"""WITH w AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, len(w) AS terms, unnest(w) AS term FROM (SELECT item_id, list_distinct({TOKENS.format('text')}) AS w FROM benchmark)),
f AS (SELECT item_id AS question, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 6) AS score, count(*) / any_value(terms) AS overlap
  FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL HAVING score > 0)"""


def _found(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), k=k)


@query(BM25 + " SELECT question, id, score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INT) AS rank FROM f QUALIFY rank <= 6")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(_found(spark, d, 6).drop("overlap"), ["question"], [F.desc("score"), F.asc("id")], 6)


@query(BM25 + """, l AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 12
UNION ALL SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY overlap DESC, id) AS rank FROM f QUALIFY rank <= 12),
r AS (SELECT question, id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM l GROUP BY ALL)
SELECT question, id, rrf, CAST(row_number() OVER (PARTITION BY question ORDER BY rrf DESC, id) AS INT) AS rank FROM r QUALIFY rank <= 6""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(_found(spark, d, 12))


@query(BM25 + """, n AS (SELECT question, id, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS v, (overlap - min(overlap) OVER w) / nullif(max(overlap) OVER w - min(overlap) OVER w, 0) AS l, overlap FROM f WINDOW w AS (PARTITION BY question))
SELECT question, id, round(0.6 * coalesce(v, 1) + 0.4 * coalesce(l, 1) + CASE WHEN overlap >= 0.75 THEN 0.5 ELSE 0 END, 5) AS score FROM n""")
def minmax_hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    strong = F.when(F.col("overlap") >= 0.75, 0.5).otherwise(0.0)
    score = 0.6 * numbers.min_max("score", ["question"], 1.0) + 0.4 * numbers.min_max("overlap", ["question"], 1.0) + strong
    return found.select("question", "id", F.round(score, 5).alias("score"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS question, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY similarity DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return retrieval.vector_top(rows, rows.where("vec_id % 50 = 0"), 5)


@query("""WITH a AS (SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY md5(text)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS turn FROM a)
SELECT doc_id, source FROM r ORDER BY turn > 8, CASE WHEN (SELECT count(*) FROM r WHERE turn <= 8) > 600 THEN turn END, CASE WHEN (SELECT count(*) FROM r WHERE turn <= 8) > 600 THEN source END, doc_id DESC LIMIT 600""")
def feed_merge_cap(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").groupBy(text.link_id("text").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))
    return retrieval.guaranteed(first.drop("id"), "source", "doc_id", "doc_id").select("doc_id", "source")


@query("SELECT 'd' || sha256(text)[1:16] AS content, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def keep_first_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.content_id("text").alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT n.event_id, n.user_id, n.event_type FROM events n WHERE n.ts >= TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.ts < TIMESTAMP '2024-01-16' AND a.event_id = n.event_id)""")
def archive_anti_insert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return sinks.unseen(rows.where("ts < TIMESTAMP '2024-01-16'"), rows.where("ts >= TIMESTAMP '2024-01-10'"), "event_id").select("event_id", "user_id", "event_type")


@query("""WITH n AS (SELECT event_id, user_id, value * 2 AS value, 1 AS b FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, value, 0 AS b FROM events UNION ALL SELECT * FROM n)
SELECT event_id, user_id, round(value, 6) AS value FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b DESC) = 1""")
def upsert_override(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_id").alias("at"))
    new = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", (F.col("value") * 2).alias("value"), F.col("event_id").alias("at"))
    return sinks.upsert(rows, new, "event_id", "at").select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 100 AS BIGINT) AS seq FROM events""")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    last = rows.groupBy("user_id").agg(F.lit(100).cast("long").alias("last"))
    return sinks.sequence(rows, last, "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("seq").cast("long"))


@query("""SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') ORDER BY conv_id DESC, turn LIMIT 200""")
def terms_and_search(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower("text")
    return table(spark, d, "conversations").where(F.forall(F.array(F.lit("the"), F.lit("and")), lambda t: F.contains(hay, t))).orderBy(F.desc("conv_id"), "turn").limit(200).select("conv_id", "turn", "role")


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', ['scheme', 'host', 'path', 'q', 'query']) AS u FROM pages),
k AS (SELECT page_id, u, array_to_string(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|ref_|mc_eid|mc_cid)')), '&') AS q FROM p)
SELECT page_id, lower(u.scheme) || '://' || lower(u.host) || CASE WHEN u.path IN ('', '/') THEN '/' ELSE rtrim(u.path, '/') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM k""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.canonical_url("url").alias("url"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))[1:300] AS title FROM pages""")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_title("html").alias("title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM a),
b AS (SELECT page_id, regexp_replace(t, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS t FROM c)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM b""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_html("html")).alias("text_md5"))


@query(r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(authorization\s*[:=]\s*)(bearer|basic)?\s*[A-Za-z0-9+/_\-.=]{8,}', '\1[REDACTED]', 'g'), '(?i)((?:api[-_]?key|x-api-key|apikey|token|secret)\s*[:=]\s*)[^\s&"'']{8,}', '\1[REDACTED]', 'g'), '(?i)(https?://)([^/@\s:]+):([^/@\s]+)@', '\1\2:[REDACTED]@', 'g'), 'sk-[A-Za-z0-9_\-]{16,}', '[REDACTED]', 'g') AS t FROM documents)
SELECT doc_id, text <> t AS changed, md5(t) AS text_md5 FROM r""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    clean = text.redact("text")
    return table(spark, d, "documents").select("doc_id", (F.col("text") != clean).alias("changed"), F.md5(clean).alias("text_md5"))


@query(r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END) AS cell_md5 FROM documents""")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.csv_guard("text")).alias("cell_md5"))


@query(r"""SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '([A-Za-z0-9][A-Za-z0-9\-_.]+|[0-9０-９]+(?:\.[0-9０-９]+)*)', 1), lambda t: rtrim(lower(t), '.-_')), lambda t: length(t) >= 2))) AS terms FROM documents""")
def lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.lexical_terms("text")).cast("long").alias("terms"))


@query("""WITH b AS (SELECT l_returnflag, l_extendedprice AS v, l_quantity AS w, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_quantity > 0),
c AS (SELECT l_returnflag, v, (sum(w) OVER (PARTITION BY l_returnflag ORDER BY k ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY l_returnflag) AS c FROM b),
q AS (SELECT l_returnflag, q, max(c) FILTER (c <= q) AS ca, arg_max(v, c) FILTER (c <= q) AS va, min(c) FILTER (c > q) AS cb, arg_min(v, c) FILTER (c > q) AS vb FROM c, (VALUES (0.1), (0.5), (0.9)) t(q) GROUP BY ALL),
r AS (SELECT l_returnflag, q, CASE WHEN ca IS NULL THEN vb WHEN cb IS NULL THEN va ELSE va + (vb - va) * (q - ca) / (cb - ca) END AS v FROM q)
SELECT l_returnflag, round(max(v) FILTER (q = 0.1), 3) AS p10, round(max(v) FILTER (q = 0.5), 3) AS p50, round(max(v) FILTER (q = 0.9), 3) AS p90 FROM r GROUP BY l_returnflag""")
def weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    q = statistics.weighted_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return q.select("l_returnflag", *(F.round(c, 3).alias(c) for c in ("p10", "p50", "p90")))


@query("""WITH f AS (SELECT o_orderpriority, quantile_cont(ln(o_totalprice), 0.25) AS a, quantile_cont(ln(o_totalprice), 0.75) AS b FROM orders GROUP BY 1 HAVING count(*) >= 4 AND min(o_totalprice) > 0),
g AS (SELECT o_orderpriority, exp(a - (b - a)) AS low, exp(b + (b - a)) AS high FROM f)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (low IS NOT NULL AND (o_totalprice < low OR o_totalprice > high)) AS outliers, round(any_value(low), 3) AS low, round(any_value(high), 3) AS high FROM orders LEFT JOIN g USING (o_orderpriority) GROUP BY 1""")
def log_iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    fences = statistics.log_fences(orders, ["o_orderpriority"], "o_totalprice", 1.0)
    out = (F.col("o_totalprice") < F.col("low")) | (F.col("o_totalprice") > F.col("high"))
    return orders.join(fences, "o_orderpriority", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(out).alias("outliers"), F.round(F.first("low"), 3).alias("low"), F.round(F.first("high"), 3).alias("high"))


@query("""SELECT l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1""")
def mc_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    moments = rows.groupBy("l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std"))
    q = statistics.quantiles(rows, ["l_linestatus"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("l_linestatus", "n", *(F.round(c, 4).alias(c) for c in ("p05", "p50", "p95"))).join(moments, "l_linestatus")


@query("""WITH e AS (SELECT l_linestatus, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1)
SELECT l_linestatus, CAST(least(floor((l_extendedprice - low) / (high - low) * 40), 39) AS INT) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_linestatus) GROUP BY ALL""")
def mc_histogram(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice")


@query("""WITH r AS (SELECT l_linestatus, rank() OVER a + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0 AS x, rank() OVER b + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS y FROM lineitem WINDOW a AS (PARTITION BY l_linestatus ORDER BY l_quantity), b AS (PARTITION BY l_linestatus ORDER BY l_extendedprice))
SELECT l_linestatus, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return statistics.spearman(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice").select("l_linestatus", F.round("spearman", 6).alias("spearman"))


@query("""WITH r AS (SELECT p_brand, p_size, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), p AS (SELECT * FROM r WHERE k = 1 AND p_retailprice > 0)
SELECT a.p_brand, least(a.p_partkey, b.p_partkey) AS a, greatest(a.p_partkey, b.p_partkey) AS b, round(a.p_retailprice / b.p_retailprice, 6) AS ratio FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_retailprice > 1.05 * b.p_retailprice""")
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    reps = evidence.representatives(table(spark, d, "part"), ["p_brand", "p_size"], "p_retailprice", "p_partkey")
    return evidence.contradictions(reps, "p_brand", "p_partkey", "p_retailprice", 1.05).withColumn("ratio", F.round("ratio", 6))


@query("""WITH s AS (SELECT md5(text) AS k, list_distinct(list(lang)) AS own FROM documents GROUP BY 1), e AS (SELECT unnest(own) AS lang, len(own) AS k FROM s)
SELECT lang, count(*) AS sources, count(*) FILTER (k = 1) AS only_here, count(*) FILTER (k = (SELECT count(DISTINCT lang) FROM documents)) AS shared_by_all FROM e GROUP BY lang""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage(table(spark, d, "documents").select(F.md5("text").alias("key"), "lang"), "key", "lang")


@query("""WITH c AS (SELECT source, lang, quality, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS e FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, count(DISTINCT lang) AS engines, count(DISTINCT quality) AS "values", CAST(sum(e) AS BIGINT) AS evidence FROM c GROUP BY source)
SELECT *, CASE WHEN "values" > 1 THEN 'conflict' WHEN evidence = 0 THEN 'unsupported' WHEN engines = 4 AND engines > 1 THEN 'agreement' ELSE 'partial' END AS verdict FROM g""")
def claim_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("e", F.when(F.col("quality") == 1, 1).otherwise(0))
    return evidence.compare(rows, "source", "lang", "quality", "e", 4)


@query("""WITH u AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, url[1:5] = 'https' AS s FROM pages), g AS (SELECT host, array_to_string(list_sort(list_distinct(list(CASE WHEN s THEN 'https' ELSE 'http' END))), ',') AS engines FROM u GROUP BY host)
SELECT 'S' || row_number() OVER (ORDER BY host) AS name, host, engines FROM g""")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.when(F.col("url").startswith("https"), "https").otherwise("http").alias("scheme"))
    return evidence.registry(rows, "host", "scheme")


EDGES = """WITH l AS (SELECT 2 * o_custkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM l GROUP BY 1, 2),
g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), t AS (SELECT node FROM g ORDER BY degree DESC, node LIMIT 300)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers (even) and suppliers (odd) that trade."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.undirected(rows.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")))


@query(EDGES + " SELECT node, degree FROM g ORDER BY degree DESC, node LIMIT 300")
def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_nodes(_edges(spark, d), 300)


@query(EDGES + " SELECT * FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.induced(edges, graph.top_nodes(edges, 300))


@query(EDGES + """, s AS (SELECT node FROM g WHERE node % 50 = 0), w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h AS (SELECT node AS seed, node, 0 AS hops FROM s UNION ALL SELECT node, dst, 1 FROM s JOIN w ON src = node)
SELECT seed, node, min(hops) AS hops FROM h GROUP BY ALL""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    seeds = graph.degrees(edges).where("node % 50 = 0").select(F.col("node").alias("seed"))
    return graph.reach(edges, seeds, 1)


@query()
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(graph.both_ways(_edges(spark, d)), rounds=30).select("node", F.round("rank", 9).alias("rank"))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT md5(text) AS t, source AS s FROM documents), e AS (SELECT DISTINCT x.s AS a, y.s AS b FROM k x JOIN k y USING (t)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def source_components(spark: SparkSession, d: str) -> DataFrame:
    """Sources that share a text, directly or over others. Each text links its sources to the least of them only."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("t"), "source").distinct()
    least = rows.groupBy("t").agg(F.min("source").alias("least"))
    links = rows.join(least, "t").where("source <> least").select(F.col("least").alias("src"), F.col("source").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    found = graph.components(links)
    return rows.select(F.col("source").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query("""SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))""")
def skyline(spark: SparkSession, d: str) -> DataFrame:
    return evidence.skyline(table(spark, d, "part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT user_id, max(event_id) AS last_seq, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS last_value, count(*) AS events, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY user_id""")
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    return ev.fold(table(spark, d, "events"), "user_id", "event_id", "event_type", "value", ["click", "error"])


#: A session goes on from a view to a click and to a purchase; a signup may come first.
STEPS = {"signup": ["view"], "view": ["click", "error"], "click": ["purchase", "view", "error"], "purchase": ["view"], "error": ["view", "click"]}
PAIRS = ", ".join(f"('{a}', '{b}')" for a, bs in STEPS.items() for b in bs)


@query(f"""WITH p AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events)
SELECT user_id, before, after, count(*) AS n FROM p WHERE before <> after AND (before, after) NOT IN ({PAIRS}) GROUP BY ALL""")
def state_transition_violations(spark: SparkSession, d: str) -> DataFrame:
    return ev.violations(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", STEPS)


@query("""WITH a AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, g, count(*) AS n FROM a WHERE f GROUP BY ALL) SELECT user_id, count(*) FILTER (n >= 3) AS opened, max(n) AS longest FROM r GROUP BY user_id""")
def breaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return ev.breakers(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id, event_type))) / 1e6 AS s FROM events)
SELECT event_id, CASE WHEN s > 0 THEN round(k / s, 9) END AS rate, CASE WHEN s > 0 THEN round((n - k) / (k / s), 3) END AS "left" FROM e""")
def eta_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type")
    rows = rows.withColumn("k", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(w))
    return ev.eta(rows, "user_id", "event_type", "ts", F.col("k"), F.col("n")).select("event_id", F.round("rate", 9).alias("rate"), F.round("left", 3).alias("left"))


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text[1:40] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '(none)') AS section FROM conversations""")
def section_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    head = F.when(F.col("role") == "user", F.substring("text", 1, 40))
    return rows.select("conv_id", "turn", retrieval.fill_forward(rows, "conv_id", "turn", head, "(none)").alias("section"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 150""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.even_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 150).select("doc_id", "source")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), s AS (SELECT *, length(line) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, k) AS r FROM l)
SELECT doc_id, round(avg(score) FILTER (r <= 3), 6) AS score, count(*) AS n_chunks FROM s GROUP BY doc_id""")
def document_aggregate(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("score", F.length("line").cast("double"))
    return retrieval.document_scores(chunks, "doc_id", "score", "k", 3)


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return sinks.newest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query("""SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) = 'purchase')""")
def retention_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    last = rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))
    return sinks.expired(rows, last, "user_id", F.col("status") == "purchase", F.col("ts") < F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("""WITH o AS (SELECT o_custkey, bool_and(o_orderstatus <> 'O') AS over, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS good FROM orders GROUP BY 1)
SELECT o_custkey, runs, good, CASE WHEN good = runs THEN 'completed' WHEN good > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM o WHERE over""")
def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return ev.finished(table(spark, d, "orders"), "o_custkey", status != "O", status == "F", F.lit(False))


@query("""SELECT user_id, max(ts) AS seen, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id HAVING status IN ('view', 'click') AND seen < TIMESTAMP '2024-01-31 22:00:00'""")
def stuck_runs(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.max_by("event_type", "event_id").alias("status"))
    return ev.stuck(last, "status", "seen", F.lit("2024-01-31 22:00:00").cast("timestamp"), ["view", "click"], 0)


@query("""WITH e AS (SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'A' WHEN d.lang = 'fr' THEN 'B' WHEN d.lang = 'de' THEN 'D' ELSE 'E' END AS cls, l.toxic = 1 AS copied, l.quality = 1 AS v, d.n_chars > 1000 AS def, d.n_chars > 2000 AS m, CAST(2026 - d.n_chars % 30 AS INT) AS y, d.lang FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, round(greatest(0, least(100, 0.18 * CASE cls WHEN 'A' THEN 85 WHEN 'B' THEN 70 WHEN 'D' THEN 40 ELSE 20 END + 0.14 * CASE WHEN copied THEN 30 WHEN cls = 'A' THEN 92 WHEN cls = 'B' THEN 75 ELSE 45 END + 0.18 * CASE WHEN v AND def THEN 88 WHEN v THEN 75 ELSE 50 END + 0.12 * CASE WHEN m THEN 85 ELSE 25 END + 0.08 * CASE WHEN lang = 'en' THEN 95 ELSE 25 END + 0.07 * 55
+ 0.08 * CASE WHEN 2026 - y <= 2 THEN 95 ELSE greatest(95 - 10 * (2026 - y - 2), 10) END + 0.05 * greatest(100 * pow(0.5, (2026 - y) / 5.0), 5) + 0.05 * CASE WHEN copied THEN 30 ELSE 85 END + 0.05 * CASE WHEN cls = 'A' OR m THEN 85 ELSE 60 END
- CASE WHEN copied THEN 12 ELSE 0 END - CASE WHEN NOT def THEN 10 ELSE 0 END - CASE WHEN 2026 - y > 8 THEN 10 ELSE 0 END - CASE WHEN NOT m AND cls IN ('D', 'E') THEN 15 ELSE 0 END)), 4) AS score FROM e""")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    cls = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "fr", "B").when(F.col("lang") == "de", "D").otherwise("E")
    copied, value, definition, method, year = F.col("toxic") == 1, F.col("quality") == 1, F.col("n_chars") > 1000, F.col("n_chars") > 2000, 2026 - F.col("n_chars") % 30
    scores = evidence.subscores(cls, copied, value, definition, method, F.col("lang"), F.lit("en"), year, 2026, F.lit(True))
    bad = {"secondary_citation": copied, "unclear_definition": ~definition, "stale_data": 2026 - year > 8, "unverifiable_claim": ~method & cls.isin("D", "E")}
    return rows.select("doc_id", F.round(evidence.total(scores, bad), 4).alias("score"))


@query("""WITH m AS (SELECT lower(p_name) AS key, p_brand, p_type, p_partkey FROM part), a AS (SELECT key, p_brand AS x, count(*) AS n, min(p_partkey) AS f FROM m GROUP BY ALL), b AS (SELECT key, p_type AS x, count(*) AS n, min(p_partkey) AS f FROM m GROUP BY ALL)
SELECT key, count(*) AS n, (SELECT x FROM a WHERE a.key = m.key ORDER BY n DESC, f LIMIT 1) AS name, (SELECT x FROM b WHERE b.key = m.key ORDER BY n DESC, f LIMIT 1) AS kind FROM m GROUP BY key""")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("key", F.lower("p_name"))
    return evidence.merge_entities(rows, "key", "p_brand", "p_type", "p_type", "p_partkey").select("key", "n", F.col("name"), "kind")


@query("""WITH r AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_suppkey AS s, l_partkey AS t, l_quantity AS q, l_orderkey * 10 + l_linenumber AS k FROM lineitem)
SELECT arg_min(s, (k, s, t)) AS source, arg_min(t, (k, s, t)) AS target, max(q) AS strength, count(*) AS n FROM r GROUP BY a, b""")
def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("k", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_suppkey", "l_partkey"))
    return evidence.merge_relations(rows, "l_suppkey", "l_partkey", "l_quantity", "k")


@query("""SELECT doc_id, len(regexp_split_to_array(text, '\\n\\s*\\n')) AS blocks, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, chr(32) || chr(10) || chr(9)) <> '')) AS filled FROM documents""")
def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    counts = readers.paragraph_blocks(docs, "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("filled"))
    return docs.select("doc_id", F.size(F.split("text", r"\n\s*\n")).cast("long").alias("blocks")).join(counts, "doc_id", "left").fillna(0, ["filled"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), t AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 'Title' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'Table' ELSE 'Text' END AS type FROM l),
f AS (SELECT *, CASE WHEN type = 'Title' OR lag(type) OVER w IS DISTINCT FROM type THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY k)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM f),
g AS (SELECT doc_id, block, type, string_agg(line, chr(10) ORDER BY k) AS c FROM b GROUP BY ALL)
SELECT type, count(*) AS blocks, CAST(sum(length(c)) AS BIGINT) AS chars FROM (SELECT type, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS c FROM g) WHERE c <> '' GROUP BY type""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = readers.markdown_blocks(table(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("type").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


@query("""SELECT lower(l_returnflag) AS flag, count(*) AS n, round(avg(l_discount), 8) AS mean FROM lineitem GROUP BY 1""")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.lower("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("mean"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object(embedded.first_json("props"), "$.k").alias("k"))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunked(table(spark, d, "documents"), "doc_id", "text").select("chunk", "pos", F.length("content").alias("n"), F.md5("content").alias("content_md5"))


@query("""WITH RECURSIVE k AS (SELECT doc_id AS id, md5(text) AS k FROM documents UNION ALL SELECT doc_id, 'l' || split_part(text, chr(10), 1) FROM documents WHERE split_part(text, chr(10), 1) <> ''), m AS (SELECT k, min(id) AS least FROM k GROUP BY k), e AS (SELECT DISTINCT id AS a, least AS b FROM k JOIN m USING (k) WHERE id <> least), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a)
SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS cluster FROM documents LEFT JOIN r ON a = doc_id GROUP BY doc_id""")
def reprint_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), F.substring_index("text", "\n", 1).alias("line"))
    return clusters.reprints(rows, "doc_id", ["hash", "line"])


@query()
def claim_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "system").alias("key"), F.col("text").alias("claim"))
    return clusters.greedy_claims(rows, "conv_id", "turn", "key", "claim", "turn")


def _brands(spark: SparkSession, d: str) -> DataFrame:
    """Brands as models: a price with its spread, a mean size and a count."""
    q = statistics.quantiles(table(spark, d, "part"), ["p_brand"], "p_retailprice", {"price_low": 0.1, "price_mid": 0.5, "price_high": 0.9})
    size = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size_mid"))
    return q.join(size, "p_brand").select("p_brand", "price_low", "price_mid", "price_high", (F.col("size_mid") * 0.8).alias("size_low"), "size_mid", (F.col("size_mid") * 1.3).alias("size_high"), (F.col("n") * 0.9).alias("count_low"), F.col("n").cast("double").alias("count_mid"), (F.col("n") * 1.2).alias("count_high"))


@query()
def simulate_brands(spark: SparkSession, d: str) -> DataFrame:
    draws = simulation.simulate(_brands(spark, d), "p_brand", "price * count / size", {"price": "lognormal", "size": "triangular", "count": "uniform"}, 2000, 20260710)
    return simulation.summary(draws, "p_brand").select("p_brand", "n", "failed", *(F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p50", "p90")))


@query("""WITH b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS pl, quantile_cont(p_retailprice, 0.5) AS pm, quantile_cont(p_retailprice, 0.9) AS ph, avg(p_size) AS s, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT p_brand, 'price' AS name, pl * n / s AS low, ph * n / s AS high, 1.0 AS e FROM b UNION ALL SELECT p_brand, 'size', pm * n / (0.8 * s), pm * n / (1.3 * s), (1 / 1.01 - 1 / 0.99) / 0.02 FROM b UNION ALL SELECT p_brand, 'count', pm * 0.9 * n / s, pm * 1.2 * n / s, 1.0 FROM b)
SELECT p_brand, name, round(low + 1e-7, 4) AS low, round(high + 1e-7, 4) AS high, round(abs(high - low) + 1e-7, 4) AS span, round(e, 6) AS elasticity, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY abs(high - low) DESC, name) AS INT) AS rank, round(abs(high - low) / sum(abs(high - low)) OVER (PARTITION BY p_brand), 6) AS share FROM r""")
def sensitivity_brands(spark: SparkSession, d: str) -> DataFrame:
    found = simulation.sensitivity(_brands(spark, d), "p_brand", "price * count / size", ["price", "size", "count"])
    return found.select("p_brand", "name", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("low", "high", "span")), F.round("elasticity", 6).alias("elasticity"), "rank", F.round("share", 6).alias("share"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 0 END AS level FROM events)
SELECT event_id, coalesce((SELECT max(p.event_id) FROM e p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.level > 0 AND (e.level = 0 OR p.level < e.level)), -1) AS parent FROM e""")
def event_outline(spark: SparkSession, d: str) -> DataFrame:
    """Events as an outline: signups above views above clicks above the rest."""
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(0)
    return trees.outline(table(spark, d, "events").withColumn("level", level), "user_id", "event_id", "level").select("event_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("""WITH b AS (SELECT p_brand, p_retailprice AS v, p_size AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part WHERE p_size > 0),
c AS (SELECT p_brand, v, w, (sum(w) OVER (PARTITION BY p_brand ORDER BY k ROWS UNBOUNDED PRECEDING) - w / 2.0) / sum(w) OVER (PARTITION BY p_brand) AS c FROM b),
q AS (SELECT p_brand, q, max(c) FILTER (c <= q) AS ca, arg_max(v, c) FILTER (c <= q) AS va, min(c) FILTER (c > q) AS cb, arg_min(v, c) FILTER (c > q) AS vb FROM c, (VALUES (0.1), (0.5), (0.9)) t(q) GROUP BY ALL),
r AS (SELECT p_brand, q, CASE WHEN ca IS NULL THEN vb WHEN cb IS NULL THEN va ELSE va + (vb - va) * (q - ca) / (cb - ca) END AS v FROM q),
e AS (SELECT p_brand, max(v) FILTER (q = 0.1) AS a, max(v) FILTER (q = 0.5) AS m, max(v) FILTER (q = 0.9) AS z FROM r GROUP BY p_brand), n AS (SELECT p_brand, count(*) AS n, avg(w) AS mean FROM b GROUP BY p_brand)
SELECT p_brand, n, round(CASE WHEN n = 1 THEN m / 1.5 WHEN z / a < 1.1 THEN m / 1.15 ELSE a END, 4) AS low, round(m, 4) AS median, round(CASE WHEN n = 1 THEN m * 1.5 WHEN z / a < 1.1 THEN m * 1.15 ELSE z END, 4) AS high, round(least(1, mean / 100 * (1 + 0.05 * (n - 1))), 6) AS confidence FROM e JOIN n USING (p_brand)""")
def fused_estimates(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.fuse(table(spark, d, "part"), "p_brand", "p_retailprice", "p_size", "p_partkey")
    return found.select("p_brand", "n", *(F.round(c, 4).alias(c) for c in ("low", "median", "high")), F.round("confidence", 6).alias("confidence"))


@query("""SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_seq, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """The event table read as a stream to its end; each micro-batch replaces the table of totals, so running one again changes nothing."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern may name a file, too
    totals = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_seq"), F.round(F.sum("value"), 4).alias("total"))
    out, log = stage_path(spark), stage_path(spark)
    write = totals.writeStream.outputMode("complete").option("checkpointLocation", log).trigger(availableNow=True)
    write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


@query()
def context_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return packing.packed(lines.select("doc_id", "pos", F.length("line").alias("size")), "doc_id", "pos", "size")
