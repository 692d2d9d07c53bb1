"""Queries of graph retrieval, entity resolution, communities and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, knowledge, retrieval, trees
from ..sources.tables import stage, table
from .queries import EDGES, _edges, query


def _communities_sql(rounds: int) -> str:
    """Label propagation, each half round a step. A node moves to the heaviest label of its neighbours, the least on a tie."""
    out = EDGES + ", w AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), s0 AS (SELECT DISTINCT src AS node, src AS label FROM w)"
    for k in range(2 * rounds):
        half = f"md5(src || '/{k // 2}') {'<' if k % 2 == 0 else '>='} '8'"
        out += f""", b{k} AS MATERIALIZED (SELECT src, arg_min(label, (-n, label)) AS label FROM (SELECT src, label, sum(weight) AS n FROM w JOIN s{k} ON dst = node WHERE {half} GROUP BY ALL) GROUP BY src),
s{k + 1} AS MATERIALIZED (SELECT node, coalesce(b{k}.label, s{k}.label) AS label FROM s{k} LEFT JOIN b{k} ON src = node)"""
    return out + f" SELECT node, label AS community FROM s{2 * rounds}"


@query(_communities_sql(20))
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Of the trade graph; twenty rounds at most are the method's own limit."""
    return graph.communities(_edges(spark, d))


@query("""WITH p AS (SELECT p_brand AS community, p_partkey AS node FROM part), s AS (SELECT community, count(*) AS size, min(node) AS least FROM p GROUP BY 1) SELECT community, size, 'C' || row_number() OVER (ORDER BY size DESC, least) AS name FROM s""")
def community_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_order(table(spark, d, "part").select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("node")))


RELATIONS = """WITH r AS (SELECT l_suppkey AS source, l_partkey AS target, max(l_quantity) AS strength FROM lineitem GROUP BY ALL), t AS (SELECT c_custkey AS question, c_custkey % 20 + 1 AS key, 1 AS rank FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT c_custkey, c_custkey % 17 + 30, 2 FROM customer WHERE c_custkey % 50 = 0)"""


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_quantity").alias("strength"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    """Two entities for each fiftieth customer."""
    k = F.col("c_custkey")
    pair = F.explode(F.array(F.struct((k % 20 + 1).alias("key"), F.lit(1).alias("rank")), F.struct((k % 17 + 30).alias("key"), F.lit(2).alias("rank"))))
    return table(spark, d, "customer").where("c_custkey % 50 = 0").select(k.alias("question"), pair.alias("p")).select("question", "p.key", "p.rank")


@query(RELATIONS + ", k AS (SELECT p_partkey AS key FROM part WHERE p_size > 10) SELECT source, target, strength FROM r WHERE source IN (SELECT key FROM k) AND target IN (SELECT key FROM k)")
def known_relations(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.known_relations(_relations(spark, d), table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("key")))


@query(RELATIONS + """, e AS (SELECT question, source, target, strength FROM r JOIN t ON source = key UNION SELECT question, source, target, strength FROM r JOIN t ON target = key)
SELECT question, source, target, strength, CAST(row_number() OVER (PARTITION BY question ORDER BY strength DESC, source, target) AS INT) AS rank FROM e QUALIFY rank <= 20""")
def relation_hits(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.relation_hits(_top(spark, d), _relations(spark, d)).select("question", "source", "target", "strength", "rank")


@query(RELATIONS + """, c AS (SELECT l_suppkey AS key, l_orderkey AS chunk, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 2), x AS (SELECT key, chunk, row_number() OVER (PARTITION BY key ORDER BY chunk, n) - 1 AS pos FROM c),
f AS (SELECT question, chunk, min(rank * 10000000 + pos) AS f FROM t JOIN x USING (key) WHERE chunk % 3 <> 0 GROUP BY ALL)
SELECT question, chunk, CAST(row_number() OVER (PARTITION BY question ORDER BY f, chunk) AS INT) AS at FROM f""".replace(" AS at ", ' AS "at" '))
def entity_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as entities, orders as chunks; every third order is unknown."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2")
    entities = lines.groupBy(F.col("l_suppkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda r: r["l_orderkey"]).alias("chunks"))
    chunks = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("chunk"))
    return knowledge.entity_chunks(_top(spark, d), entities, chunks)


@query(RELATIONS + """, m AS (SELECT p_brand AS community, p_partkey AS key, min(p_partkey) OVER (PARTITION BY p_brand) AS place FROM part), f AS (SELECT question, community, min(place) AS place FROM t JOIN m USING (key) GROUP BY ALL)
SELECT question, community, CAST(row_number() OVER (PARTITION BY question ORDER BY place) AS INT) AS rank FROM f QUALIFY rank <= 3""")
def community_hits(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("place"))
    members = part.join(first, "p_brand").select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("key"), "place")
    return knowledge.community_hits(_top(spark, d), members)


@query("""WITH n AS (SELECT DISTINCT lower(p_name[1:6]) AS n FROM part), c AS (SELECT DISTINCT conv_id, turn FROM conversations, n WHERE contains(lower(text), n))
SELECT conv_id * 1000 + turn AS question, CASE WHEN (conv_id, turn) IN (SELECT conv_id, turn FROM c) THEN 'local' ELSE 'global' END AS route FROM conversations""")
def entity_routes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as questions, beginnings of parts' names as entities."""
    asked = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), "text")
    names = table(spark, d, "part").select(F.substring("p_name", 1, 6).alias("name")).distinct().withColumn("key", F.col("name"))
    return knowledge.routed(asked, knowledge.mentions(asked, names, "question", "text", "name"), "question").select("question", "route")


@query("""SELECT event_id FROM events WHERE event_type = 'view' AND user_id BETWEEN 3 AND 9 AND contains(lower(props), '{"k"')""")
def block_filters(spark: SparkSession, d: str) -> DataFrame:
    """Views as tables among blocks, users as pages."""
    blocks = table(spark, d, "events").withColumn("type", F.when(F.col("event_type") == "view", "Table").otherwise("Text"))
    picked = knowledge.page_range(knowledge.modal(blocks, "type", "table"), "user_id", "3-9")
    return knowledge.name_filter(picked, "props", "type", '{"K"', "Table").select("event_id")


@query("""SELECT l_orderkey AS node, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS keys FROM lineitem GROUP BY 1""")
def entity_origins(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.collect_set("l_orderkey").alias("nodes"))
    return knowledge.origins(entities).select("node", F.array_join("keys", ",").alias("keys"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS question, 'Vector ' || (vec_id % 70) AS name, e FROM v WHERE vec_id % 10 = 0), n AS (SELECT vec_id AS key, 'vector ' || vec_id AS n, e FROM v WHERE vec_id % 3 = 0),
x AS (SELECT question, key FROM q JOIN n ON lower(name) = n), y AS (SELECT question, key, round(list_cosine_similarity(q.e, n.e), 6) AS s FROM q JOIN n ON question <> key WHERE question NOT IN (SELECT question FROM x)), z AS (SELECT * FROM y WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY question ORDER BY s DESC, key) = 1)
SELECT question, key FROM x UNION SELECT question, key FROM z""")
def linked_entities(spark: SparkSession, d: str) -> DataFrame:
    """Vectors asked for by name, or else by their nearest neighbour."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("question"), F.concat(F.lit("Vector "), (F.col("vec_id") % 70).cast("string")).alias("name"))
    known = rows.where("vec_id % 3 = 0")
    entities = known.select(F.col("vec_id").alias("key"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("name"))
    near = retrieval.vector_top(known, rows.where("vec_id % 10 = 0"), 1).select("question", F.col("id").alias("key"), "similarity").join(asked, "question")
    return knowledge.linked(asked, entities, near, 0.3)


TREE = """WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 0 END AS level FROM events),
p AS MATERIALIZED (SELECT *, (SELECT max(p.event_id) FROM e p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.level > 0 AND (e.level = 0 OR p.level < e.level)) AS parent FROM e)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "signup", 1).when(kind == "view", 2).when(kind == "click", 3).otherwise(0)
    return stage(trees.outline(table(spark, d, "events").select("user_id", "event_id", "event_type", level.alias("level")), "user_id", "event_id", "level"))


@query("WITH RECURSIVE " + TREE[5:] + """, a AS (SELECT event_id AS node, parent, 1 AS steps FROM p WHERE parent IS NOT NULL UNION ALL SELECT a.node, p.parent, steps + 1 FROM a JOIN p ON p.event_id = a.parent WHERE p.parent IS NOT NULL)
SELECT node, string_agg(p.event_type, ' / ' ORDER BY steps DESC) AS path FROM a JOIN p ON p.event_id = a.parent GROUP BY node""")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return trees.heading_paths(_tree(spark, d), "user_id", "event_id", "event_type").select("node", "path")


@query("WITH RECURSIVE " + TREE[5:] + """, a AS (SELECT event_id AS root, event_id AS node FROM p WHERE event_type = 'signup' UNION ALL SELECT root, p.event_id FROM a JOIN p ON p.parent = a.node) SELECT root, count(*) AS n, CAST(sum(node) AS BIGINT) AS ids FROM a GROUP BY root""")
def subtrees(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    roots = tree.where("event_type = 'signup'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("root"))
    return trees.subtree(tree, "user_id", "event_id", roots).groupBy("root").agg(F.count("*").alias("n"), F.sum("node").alias("ids"))


@query("WITH RECURSIVE " + TREE[5:] + """, k AS (SELECT event_id AS node FROM p WHERE event_id % 20 = 0), u AS (SELECT node, node AS here, 0 AS steps FROM k UNION ALL SELECT u.node, p.parent, steps + 1 FROM u JOIN p ON p.event_id = u.here WHERE p.parent IS NOT NULL),
n AS (SELECT node, arg_min(here, steps) AS root FROM u JOIN p ON p.event_id = u.here WHERE p.event_type = 'view' GROUP BY node), r AS (SELECT DISTINCT root FROM n),
a AS (SELECT root, root AS node FROM r UNION ALL SELECT root, p.event_id FROM a JOIN p ON p.parent = a.node), s AS (SELECT root, node, p.event_type = 'view' AS sec, bool_or(p.event_type <> 'view') OVER (PARTITION BY root) AS other FROM a JOIN p ON p.event_id = node)
SELECT DISTINCT node FROM s WHERE NOT (sec AND other)""")
def entity_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth event's section (a view) with all that is below it."""
    tree = _tree(spark, d)
    picked = tree.where("event_id % 20 = 0").select(F.col("user_id").alias("doc"), F.col("event_id").alias("node"))
    return knowledge.sections_of(picked, tree, "user_id", "event_id", F.col("event_type") == "view").select("node")


@query("""WITH p AS (SELECT conv_id AS question, role || turn AS community, turn % 6 AS score FROM conversations) SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, community) AS INT) AS rank FROM p WHERE score >= 2 QUALIFY rank <= 12""")
def best_points(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.best_points(table(spark, d, "conversations").select(F.col("conv_id").alias("question"), F.concat("role", F.col("turn").cast("string")).alias("community"), (F.col("turn") % 6).alias("score")))


@query()
def graph_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of orders as entities of blocks; parts traded by two suppliers relate them."""
    lines = table(spark, d, "lineitem").where("l_orderkey % 40 = 0")
    node_keys = lines.groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_set("l_suppkey").alias("keys"))
    pairs = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("src"), F.max("l_suppkey").alias("dst")).where("src <> dst").select("src", "dst")
    seeds = pairs.select(F.col("src").alias("node")).distinct().where("node % 7 = 0").withColumn("weight", F.lit(1.0))
    return knowledge.graph_scores(node_keys.select("node"), node_keys, graph.both_ways(pairs.withColumn("weight", F.lit(1.0))).select("src", "dst"), seeds, 20).select("node", F.round("score", 6).alias("score"))


@query()
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of a label as the mentions of a book."""
    return knowledge.resolve(table(spark, d, "embeddings"), "label", "vec_id", "label", "embedding")


@query("""WITH r AS (SELECT r_regionkey, r_name || '|' || 'nations' || chr(10) || string_agg(n_name || '|' || n_nationkey, chr(10) ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name),
h AS (SELECT r_regionkey, unnest(list_concat([r_name, 'nations'], (SELECT list(n_name ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey))) AS header, r_name FROM region)
SELECT r_regionkey, 'T: ' || r_name || ' / nations' AS "table", header FROM h""")
def table_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat_ws("|", r["n_name"], r["n_nationkey"])), "\n").alias("body"))
    tables = table(spark, d, "region").join(rows, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.lit("T").alias("title"), F.concat("r_name", F.lit("|nations\n"), "body").alias("text"))
    return knowledge.table_entities(tables, "r_regionkey", "title", "text")


LINES = """l AS (SELECT doc_id AS doc, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) AS z FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc, z[1] AS node, CASE WHEN length(z[2]) % 3 = 0 AND doc % 10 <> 9 THEN length(z[2]) % 4 + 1 ELSE 0 END AS level FROM l), s AS (SELECT b.*, embedding FROM b LEFT JOIN embeddings ON vec_id = (doc * 7 + node) % 120 WHERE level > 0),
q AS (SELECT doc_id AS doc, embedding AS q FROM documents LEFT JOIN embeddings ON vec_id = doc_id % 90 WHERE text IS NOT NULL),
r AS (SELECT doc, node, level, row_number() OVER (PARTITION BY doc ORDER BY coalesce(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0) DESC, node) AS rank FROM s JOIN q USING (doc))"""


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of documents as an outline, in which some are headings; vectors of the headings, and a question to each document."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("node", "line"))
    size = F.length("line")
    blocks = lines.select("doc", "node", F.when((size % 3 == 0) & (F.col("doc") % 10 != 9), size % 4 + 1).otherwise(0).alias("level"))
    tree = stage(trees.outline(blocks, "doc", "node", "level"))
    titles = tree.where("level > 0").join(vectors, (F.col("doc") * 7 + F.col("node")) % 120 == F.col("vec_id"), "left").select("doc", "node", "vector")
    asked = docs.select("doc", F.col("doc").alias("question")).join(vectors, F.col("doc") % 90 == F.col("vec_id"), "left").select("question", "doc", "vector")
    return tree, titles, asked


@query("WITH " + LINES + " SELECT doc AS question, doc, node, CAST(rank AS INT) AS rank FROM r WHERE rank <= 60")
def section_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The headings of a document that a model would choose from."""
    _, titles, asked = _lines(spark, d)
    return knowledge.ranked_sections(asked, titles)


@query("WITH " + LINES + """, c AS (SELECT doc_id AS doc, unnest([0, 1, 4, 999999]) AS node FROM documents WHERE doc_id % 3 = 0), t AS (SELECT *, count(c.doc) OVER (PARTITION BY r.doc) AS told, c.doc IS NOT NULL AS own FROM r LEFT JOIN c ON c.doc = r.doc AND c.node = r.node),
root AS (SELECT r.doc, r.node AS root, r.level FROM (SELECT doc, node, level, own, told, rank FROM t) r WHERE CASE WHEN told > 0 THEN own ELSE rank <= 3 END),
e AS (SELECT root.doc, root, min(b.node) AS fin FROM root LEFT JOIN b ON b.doc = root.doc AND b.node > root AND b.level BETWEEN 1 AND root.level GROUP BY ALL),
w AS (SELECT DISTINCT b.doc, b.node, b.level FROM e JOIN b ON b.doc = e.doc AND b.node >= root AND (fin IS NULL OR b.node < fin) UNION ALL SELECT doc, node, level FROM b WHERE doc NOT IN (SELECT doc FROM s)),
k AS (SELECT *, bool_or(level = 0) OVER (PARTITION BY doc) AS other FROM w) SELECT doc AS question, doc, node FROM k WHERE level = 0 OR NOT other""")
def selected_sections(spark: SparkSession, d: str) -> DataFrame:
    """What is below the headings that were chosen for every third document, some of which are none, or below the three nearest."""
    tree, titles, asked = _lines(spark, d)
    chosen = asked.where("question % 3 = 0").select("question", F.explode(F.array(*map(F.lit, (0, 1, 4, 999_999)))).alias("node"))
    return knowledge.selected_by_section(asked, titles, tree, "doc", "node", F.col("level") > 0, chosen)
