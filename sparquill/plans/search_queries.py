"""Queries of hybrid search, its scope and its listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, clusters, retrieval, search
from ..sources.tables import stage, table
from .queries import BM25, query

TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '([A-Za-z0-9][A-Za-z0-9\\-_.]+|[0-9０-９]+(?:\\.[0-9０-９]+)*)', 1), lambda t: rtrim(lower(t), '.-_')), lambda t: length(t) >= 2))"

LEXICAL = f"""WITH q AS (SELECT item_id AS question, unnest({TERMS.format('text')}) AS term FROM benchmark), d AS (SELECT doc_id AS id, unnest({TERMS.format('text')}) AS term FROM documents),
l AS (SELECT question, id, 2.0 * count(*) AS score, true AS strong FROM d JOIN q USING (term) GROUP BY ALL)"""


def _lexical(spark: SparkSession, d: str, docs: DataFrame, k: int) -> DataFrame:
    return search.lexical(docs, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", k)


@query(LEXICAL + " SELECT question, id, score, strong, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INT) AS rank FROM l QUALIFY rank <= 30")
def lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = _lexical(spark, d, table(spark, d, "documents"), 30)
    return retrieval.top(found, ["question"], [F.desc("score"), F.asc("id")], 30)


SCOPE = "(lang IN ('en', 'fr') AND source IS NOT NULL AND n_chars > 200)"


def _scope(spark: SparkSession, d: str) -> DataFrame:
    """English or French documents (collections) that are tagged as known and long."""
    docs = table(spark, d, "documents").withColumn("tags", F.filter(F.array(F.when(F.col("source").isNotNull(), "known"), F.when(F.col("n_chars") > 200, "long"), F.lit("text")), lambda t: t.isNotNull()))
    members = docs.select("doc_id", F.col("lang").alias("collection"))
    return search.scoped(docs, members, ["en", "fr"], ["known", "long"])


@query(f"SELECT lang, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE {SCOPE} GROUP BY lang")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


@query(LEXICAL.replace("FROM documents", f"FROM documents WHERE {SCOPE}") + f""", lt AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS k FROM l QUALIFY k <= 40),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), vs AS (SELECT a.vec_id AS question, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT doc_id FROM documents WHERE {SCOPE})),
vt AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS k FROM vs QUALIFY k <= 24),
vn AS (SELECT question, id, CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 1 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS v FROM vt WINDOW w AS (PARTITION BY question)),
ln AS (SELECT question, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS l FROM lt WINDOW w AS (PARTITION BY question)),
h AS (SELECT question, id, round(0.6 * coalesce(v, 0) + 0.4 * coalesce(l, 0) + CASE WHEN l IS NOT NULL THEN 0.5 ELSE 0 END, 6) AS score FROM vn FULL JOIN ln USING (question, id))
SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INT) AS rank FROM h QUALIFY rank <= 10""")
def hybrid_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The scope cuts documents before candidates are chosen: the 24 nearest vectors and the 40 best lexical hits of each benchmark item."""
    docs = stage(_scope(spark, d))
    found = retrieval.top(_lexical(spark, d, docs, 40), ["question"], [F.desc("score"), F.asc("id")], 40)
    vectors = table(spark, d, "embeddings")
    asked = vectors.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieval.vector_top(vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), asked, 24)
    return retrieval.top(search.hybrid(near, found).withColumn("score", F.round("score", 6)), ["question"], [F.desc("score"), F.asc("id")], 10)


@query(f"""WITH q AS (SELECT item_id AS question, unnest({TERMS.format('text')}) AS term FROM benchmark), d AS (SELECT conv_id, unnest({TERMS.format('text')}) AS term FROM conversations)
SELECT question, count(DISTINCT conv_id) AS docs FROM d JOIN q USING (term) GROUP BY question""")
def rescued_documents(spark: SparkSession, d: str) -> DataFrame:
    found = search.with_exact_terms(table(spark, d, "conversations"), table(spark, d, "benchmark"), "conv_id", "text", "item_id", "text")
    return found.groupBy("question").agg(F.count("*").alias("docs"))


@query(f"""WITH q AS (SELECT item_id AS question, unnest({TERMS.format('text')}) AS term FROM benchmark), t AS (SELECT conv_id AS doc, conv_id * 1000 + turn AS id, unnest({TERMS.format('text')}) AS term FROM conversations),
c AS (SELECT question, doc, id, 2.0 * count(*) AS score FROM t JOIN q USING (term) GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS k FROM c),
a AS (SELECT question, doc, max(score) AS score FROM w WHERE k <= 200 GROUP BY ALL), m AS (SELECT question, doc, max(score) AS score FROM c WHERE (question, doc) NOT IN (SELECT question, doc FROM a) GROUP BY ALL)
SELECT question, doc, score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, doc) AS INT) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM m) QUALIFY rank <= 5""")
def document_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Conversations ranked by their turns; those with an exact term come in even where no turn is among the candidates."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    asked = table(spark, d, "benchmark")
    found = stage(search.lexical(turns, asked, "id", "text", "item_id", "text").join(turns.select("id", "doc"), "id"))
    return search.rank_documents(found, found, search.with_exact_terms(turns, asked, "doc", "text", "item_id", "text"), 5, 5)


@query("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, greatest(count(*) OVER (PARTITION BY source) // 10, 1) AS step FROM documents)
SELECT source, doc_id FROM n WHERE k % step = 0 AND k < 10 * step""")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return search.stride(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 10)


@query(LEXICAL + """, r AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS place FROM l WHERE score >= 24 QUALIFY place <= 8), n AS (SELECT question, count(*) AS n FROM r GROUP BY question),
f AS (SELECT question, doc_id AS id, n, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS k FROM n, documents WHERE n < 6 AND (question, doc_id) NOT IN (SELECT question, id FROM r))
SELECT question, id, CAST(place AS INT) AS "at" FROM r UNION ALL SELECT question, id, CAST(k + n AS INT) FROM f WHERE k + n <= 6""")
def padded_passages(spark: SparkSession, d: str) -> DataFrame:
    """The best eight documents with twelve terms or more, filled up with leading ones to six."""
    docs = table(spark, d, "documents")
    found = retrieval.top(_lexical(spark, d, docs, 8).where("score >= 24"), ["question"], [F.desc("score"), F.asc("id")], 8)
    return search.padded(found, docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("place")), "place", 6, 8)


@query("""SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(role, turn) || '::' || lower(trim(text, ' ')) AS key FROM conversations GROUP BY conv_id, lower(trim(text, ' ')), text IS NULL""")
def query_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return search.query_cache(rows, "conv_id", "role", "text", "turn").select("conv_id", "turn", "key")


PURPOSES = {"definition": {"ja": "定義", "en": "definition"}, "statistics": {"ja": "統計", "en": "statistics"}, "counter_evidence": {"en": "criticism"}}


@query("""SELECT n_nationkey, purpose, lang, n_name || ' ' || suffix AS query FROM nation, (VALUES ('definition', 'ja', '定義'), ('definition', 'en', 'definition'), ('statistics', 'ja', '統計'), ('statistics', 'en', 'statistics'), ('counter_evidence', 'en', 'criticism')) p(purpose, lang, suffix)""")
def search_plan(spark: SparkSession, d: str) -> DataFrame:
    return search.plan(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", PURPOSES).drop("n_name")


@query("""SELECT i.r_regionkey, q.doc_id FROM (SELECT r_regionkey, list(lower(n_name)[1:3]) AS words FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) i JOIN documents q ON len(list_filter(i.words, lambda w: contains(lower(q.text), w))) > 0""")
def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """Regions as canned answers, found by the beginnings of their nations' names."""
    words = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.substring("n_name", 1, 3)).alias("words"))
    return search.keyword_hits(words, table(spark, d, "documents"), "words", "doc_id", "text")


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations QUALIFY rank <= 5)
SELECT conv_id, md5(string_agg(rank || '. ' || role || chr(10) || '   ' || turn || chr(10) || '   ' || coalesce(text[1:500], ''), chr(10) ORDER BY rank)) AS listing_md5 FROM t GROUP BY conv_id""")
def result_listing(spark: SparkSession, d: str) -> DataFrame:
    return search.listed(table(spark, d, "conversations"), "conv_id", "turn", "role", "turn", "text", 5).select("conv_id", F.md5("listing").alias("listing_md5"))


@query("""SELECT event_id, user_id, CAST(k AS INT) AS strategy FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS k FROM events) QUALIFY k = min(k) OVER (PARTITION BY user_id)""")
def fallback_strategies(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases, or else clicks, or else whatever there is."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    kinds = [rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), rows.where("event_type NOT IN ('purchase', 'click')")]
    return search.first_of([r.select("event_id", "user_id", F.lit(k).alias("strategy")) for k, r in enumerate(kinds)], "user_id")


@query("""SELECT item_id, CASE WHEN regexp_matches(lower(text), 'sum|average|mean|count|total|max|min') THEN 'table' ELSE 'rag' END AS route FROM benchmark""")
def table_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", checks.table_route(F.col("text")).alias("route"))


@query(f"""WITH t AS (SELECT DISTINCT lang, title FROM (SELECT lang, split_part(text, chr(10), 1) AS title FROM documents WHERE lang IS NOT NULL) WHERE title <> ''),
c AS (SELECT lang, title, len(title) AS n, map_from_entries(list_transform(list_distinct(string_split(title, '')), lambda x: (x, len(list_filter(string_split(title, ''), lambda y: y = x))))) AS bag FROM t WHERE len(title) BETWEEN 1 AND 60),
p AS (SELECT a.lang, a.title AS a, b.title AS b, 2.0 * list_sum(list_transform(map_keys(a.bag), lambda k: least(a.bag[k], coalesce(b.bag[k], 0)))) / (a.n + b.n) AS most FROM c a JOIN c b ON a.lang = b.lang AND a.title < b.title)
SELECT lang, a, b, round(most, 9) AS most FROM p WHERE most >= 0.8 - 1e-9""")
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of headings (first lines of up to 60 characters) of one language that could be alike by a ratio of 0.8."""
    rows = table(spark, d, "documents").select("lang", F.substring_index("text", "\n", 1).alias("title")).where(F.length("title").between(1, 60))
    return clusters.similar_pairs(rows, ["lang"], "title", 0.8)


@query()
def evidence_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as evidence: the same when their text is, or when they have one length and headings (first lines of up to 200 characters) alike; brute force
    in tests/test_clusters.py."""
    line = F.substring_index("text", "\n", 1)
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("hash"), F.when(F.length(line) <= 200, line).alias("title"))
    return clusters.evidence_clusters(rows, "doc_id", "source", ["hash"], ["n_chars"], "title")


@query(BM25 + """, u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u),
c AS (SELECT a.vec_id AS question, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) AS s FROM n a JOIN benchmark ON a.vec_id = item_id, n b),
l AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS rank FROM c WHERE s > 0 QUALIFY rank <= 12
UNION ALL SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 12),
r AS (SELECT question, id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM l GROUP BY ALL)
SELECT question, id, rrf, CAST(row_number() OVER (PARTITION BY question ORDER BY rrf DESC, id) AS INT) AS rank FROM r QUALIFY rank <= 6""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Vector and BM25 lists of each benchmark item, fused; an item's vector is the embedding of its number, a document's that of its own."""
    items, vectors = table(spark, d, "benchmark"), table(spark, d, "embeddings")
    lexical = retrieval.bm25(table(spark, d, "documents"), items, k=12)
    near = retrieval.vector_top(vectors, vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), 12, itself=True)
    return retrieval.both_ways(near, lexical)
