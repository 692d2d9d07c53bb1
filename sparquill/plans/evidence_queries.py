"""Queries of extraction, fusion's filters, checks and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import safety
from ..operators import checks, extraction, statistics
from ..sources.tables import table
from .queries import query


@query("""WITH u(event_type, unit, wanted) AS (VALUES ('signup', 'person', 'person'), ('view', 'event', 'event/(person*day)'), ('click', 'percent', 'item/household'), ('purchase', 'JPY', 'kilometer'), ('error', 'dimensionless', 'hour')),
e AS (SELECT event_id, value, unit, wanted FROM events JOIN u USING (event_type))
SELECT event_id, round(CASE WHEN unit = wanted THEN value WHEN unit = 'percent' THEN value / 100 WHEN unit = 'dimensionless' THEN value WHEN unit = 'event' AND contains(wanted, '/') THEN value END, 9) AS value,
CASE WHEN unit = wanted THEN '' WHEN unit IN ('percent', 'dimensionless') THEN unit WHEN unit = 'event' AND contains(wanted, '/') THEN 'count' END AS note,
CASE wanted WHEN 'person' THEN 'person' WHEN 'event/(person*day)' THEN 'event,,percent' WHEN 'item/household' THEN 'item,,percent' WHEN 'kilometer' THEN 'kilometer' WHEN 'hour' THEN 'hour' END AS expected FROM e""")
def unit_bridge(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    unit = F.when(kind == "signup", "person").when(kind == "view", "event").when(kind == "click", "percent").when(kind == "purchase", "JPY").otherwise("dimensionless")
    wanted = F.when(kind == "signup", "person").when(kind == "view", "event/(person*day)").when(kind == "click", "item/household").when(kind == "purchase", "kilometer").otherwise("hour")
    n = extraction.normalized(F.col("value"), unit, wanted)
    expected = F.array_join(F.concat(F.slice(extraction.expected_units(wanted), 1, 1), F.sort_array(F.slice(extraction.expected_units(wanted), 2, 9))), ",")
    return table(spark, d, "events").select("event_id", F.round(n["value"], 9).alias("value"), n["note"].alias("note"), expected.alias("expected"))


@query("""WITH e AS (SELECT doc_id, n_chars, n_chars * (1 + (doc_id % 5) * 0.004) AS v, 'about ' || n_chars || ' characters in all' AS excerpt, text || ' about ' || n_chars || '  characters in all' AS doc, n_chars - 5.0 AS low FROM documents)
SELECT doc_id, abs(v - n_chars) <= 0.01 * greatest(v, n_chars) AS supported, CASE WHEN doc_id % 7 = 0 THEN 'value' WHEN doc_id % 11 = 0 THEN 'not in the document' WHEN NOT abs(v - n_chars) <= 0.01 * greatest(v, n_chars) THEN 'value not in the excerpt'
WHEN NOT abs(low - n_chars) <= 0.01 * greatest(abs(low), n_chars) THEN 'low not in the excerpt' END AS refusal FROM e""")
def excerpt_support(spark: SparkSession, d: str) -> DataFrame:
    """Each document's length as a value with an excerpt that is put into its text; some lack the value or aren't in the text."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    value = F.col("n_chars") * (1 + (F.col("doc_id") % 5) * 0.004)
    excerpt = F.concat(F.lit("about "), "n_chars", F.lit(" characters in all"))
    doc = F.when(F.col("doc_id") % 11 == 0, F.lit("nothing")).otherwise(F.concat("text", F.lit(" about "), "n_chars", F.lit("  characters in all")))
    said = F.when(F.col("doc_id") % 7 != 0, value)
    return rows.select("doc_id", extraction.supported(value, excerpt).alias("supported"), extraction.refusal(said, excerpt, doc, F.col("n_chars") - 5.0, F.lit(None).cast("double")).alias("refusal"))


@query("""WITH c AS (SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), f AS (SELECT n_regionkey, arg_min(n, n_name) AS n, min(n_name) AS name FROM c GROUP BY 1)
SELECT n_regionkey, CAST(n AS DOUBLE) AS value, 'event' AS unit, 1 AS row, 2 AS "column", 'value' AS basis, '2024' AS period, name AS place FROM f""")
def grid_values(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region as a table with a column of counts; the value of the first nation by name."""
    counts = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_name").agg(F.count("c_custkey").alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n"))), lambda r: F.array(r["n_name"], r["n"].cast("string"), F.lit("2024")))
    grids = counts.groupBy("n_regionkey").agg(rows.alias("rows"), F.min("n_name").alias("first"))
    header = F.array(F.lit("国"), F.lit("件数"), F.lit("年"))
    return extraction.grid_values(grids, header, F.col("rows"), F.array("first"), F.array(F.lit("event"))).drop("rows", "first")


USABLE = """WITH e AS (SELECT p_partkey AS id, p_brand AS parameter, p_retailprice AS value, p_size * 2.0 AS score, p_partkey % 7 <> 0 AS accepted, 2026 - p_size % 20 AS year, p_type AS cluster,
CASE WHEN p_size % 5 = 1 THEN 'geography' WHEN p_partkey % 13 = 0 THEN 'period' END AS reason FROM part),
u AS (SELECT * FROM e WHERE accepted AND reason IS NULL AND score >= 20), m AS (SELECT *, max(CASE WHEN 2026 - year <= 8 AND score >= 50 THEN 1 ELSE 0 END) OVER w AS recent, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY parameter)),
k AS (SELECT * FROM m WHERE NOT (recent = 1 AND n >= 2 AND 2026 - year > 8) QUALIFY row_number() OVER (PARTITION BY parameter, cluster ORDER BY score DESC, id) = 1)"""


def _usable(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    place = F.when(F.col("p_size") % 5 == 1, "east").otherwise("west side")
    period = F.when(F.col("p_partkey") % 13 == 0, "month").otherwise("year")
    reason = statistics.incompatible(place, F.lit("west"), period, F.lit("year"))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parameter"), F.col("p_retailprice").alias("value"), (F.col("p_size") * 2.0).alias("score"), (F.col("p_partkey") % 7 != 0).alias("accepted"), (2026 - F.col("p_size") % 20).alias("year"), F.col("p_type").alias("cluster"), reason.alias("reason"))
    return statistics.usable(rows, "parameter", "score", "accepted", "reason", "year", "cluster", "id", 2026)


@query(USABLE + " SELECT parameter, id, score, year FROM k")
def usable_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _usable(spark, d).select("parameter", "id", "score", "year")


@query(USABLE + """, r AS (SELECT r_regionkey AS region, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT parameter, count(*) AS n, round(avg(value), 4) AS mean, round(max(score), 2) AS best FROM k GROUP BY parameter""")
def usable_summary(spark: SparkSession, d: str) -> DataFrame:
    return _usable(spark, d).groupBy("parameter").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("score"), 2).alias("best"))


@query("""WITH p AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 <> 0 THEN 100.0 END AS central, 10.0 AS low, 10.0 + 10 * (n_nationkey % 6) AS high, CASE WHEN n_nationkey % 3 = 0 THEN '東京' ELSE '' END AS geography, CASE WHEN n_nationkey % 5 = 0 THEN '中央値' ELSE '' END AS definition, n_nationkey % 8 = 1 AS correlated FROM nation),
e AS (SELECT s_nationkey AS parameter, s_suppkey // 3 AS cluster, s_acctbal / 100 AS score, CASE s_suppkey % 3 WHEN 0 THEN '東京都' WHEN 1 THEN '全国' ELSE '大阪' END AS geography, 2010 + s_suppkey % 16 AS year, s_suppkey % 9 = 0 AS conflict, s_suppkey % 10 = 0 AS biased, CASE WHEN s_suppkey % 2 = 0 THEN 'survey' END AS method, CASE WHEN s_suppkey % 4 = 0 THEN '平均 3' ELSE '3' END AS excerpt FROM supplier),
j AS (SELECT p.*, count(parameter) AS n, count(DISTINCT cluster) AS clusters, max(coalesce(score, 0)) AS best, count(*) FILTER (e.geography <> '' AND p.geography <> '' AND NOT contains(e.geography, p.geography)) AS elsewhere, count(*) FILTER (p.geography <> '' AND NOT contains(e.geography, p.geography) AND e.geography IN ('日本', '全国', '国内')) AS nationwide,
count(*) FILTER (2026 - year > 8) AS stale, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (biased) AS biased, count(method) AS methods, count(*) FILTER (contains(excerpt, '平均')) AS means FROM p LEFT JOIN e ON parameter = id GROUP BY ALL),
c AS (SELECT id AS parameter, n = 0 AND central IS NULL AS none, unnest([CASE WHEN n = 0 AND central IS NULL THEN {'issue': 'no_evidence', 'severity': 0.9} END, CASE WHEN clusters = 1 THEN {'issue': 'single_source', 'severity': CASE WHEN best < 75 THEN 0.6 ELSE 0.45 END} END, CASE WHEN n > clusters THEN {'issue': 'duplicate_primary_source', 'severity': 0.35} END,
CASE WHEN elsewhere > 0 THEN {'issue': 'geography_mismatch', 'severity': CASE WHEN nationwide > 0 THEN 0.5 ELSE 0.65 END} END, CASE WHEN stale > 0 THEN {'issue': 'stale_extrapolation', 'severity': 0.55} END, CASE WHEN conflicts > 0 THEN {'issue': 'conflict_of_interest', 'severity': 0.5} END, CASE WHEN n > 0 AND methods = 0 THEN {'issue': 'opaque_methodology', 'severity': 0.5} END,
CASE WHEN biased > 0 THEN {'issue': 'sample_bias', 'severity': 0.45} END, CASE WHEN low > 0 AND high / low > 5 AND NOT (n = 0 AND central IS NULL) THEN {'issue': 'wide_uncertainty', 'severity': 0.5} END, CASE WHEN means > 0 AND definition = '中央値' THEN {'issue': 'mean_median_confusion', 'severity': 0.4} END, CASE WHEN correlated AND NOT (n = 0 AND central IS NULL) THEN {'issue': 'correlated_parameters', 'severity': 0.3} END]) AS x FROM j)
SELECT parameter, x.issue AS issue, CAST(x.severity AS DOUBLE) AS severity FROM c WHERE x IS NOT NULL""")
def critiques(spark: SparkSession, d: str) -> DataFrame:
    """Nations as parameters, their suppliers as evidence."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    parameters = table(spark, d, "nation").select(k.alias("id"), F.when(k % 4 != 0, 100.0).alias("central"), F.lit(10.0).alias("low"), (10.0 + 10 * (k % 6)).alias("high"), F.when(k % 3 == 0, "東京").otherwise("").alias("geography"), F.when(k % 5 == 0, "中央値").otherwise("").alias("definition"), (k % 8 == 1).alias("correlated"))
    found = table(spark, d, "supplier").select(F.col("s_nationkey").alias("parameter"), F.floor(s / 3).alias("cluster"), (F.col("s_acctbal") / 100).alias("score"), F.when(s % 3 == 0, "東京都").when(s % 3 == 1, "全国").otherwise("大阪").alias("geography"), (2010 + s % 16).alias("year"), (s % 9 == 0).alias("conflict"), (s % 10 == 0).alias("biased"), F.when(s % 2 == 0, "survey").alias("method"), F.when(s % 4 == 0, "平均 3").otherwise("3").alias("excerpt"))
    return checks.critiques(parameters, found, 2026).select("parameter", "issue", F.col("severity").cast("double").alias("severity"))


@query("""WITH p AS (SELECT n_nationkey AS parameter, 2000.0 AS central FROM nation), e AS (SELECT c_custkey AS id, c_nationkey AS parameter, c_acctbal AS value, CAST(c_custkey % 90 AS DOUBLE) AS score, CASE WHEN c_custkey % 6 = 0 THEN '訂正のお知らせ' END AS text, central FROM customer JOIN p ON c_nationkey = parameter),
r AS (SELECT *, greatest(value, central) / least(value, central) AS ratio FROM e)
SELECT parameter, id, 'retraction_or_revision' AS issue, 0.6 AS severity FROM r WHERE text IS NOT NULL
UNION ALL SELECT parameter, id, 'counter_evidence_exists', round(least(0.3 + 0.1 * ratio, 0.8) * least(1, CASE WHEN score = 0 THEN 30 ELSE score END / 60), 2) FROM r WHERE value > 0 AND ratio > 2""")
def counter_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    parameters = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(2000.0).alias("central"))
    found = table(spark, d, "customer").select(F.col("c_nationkey").alias("parameter"), k.alias("id"), F.col("c_acctbal").alias("value"), (k % 90).cast("double").alias("score"), F.when(k % 6 == 0, "訂正のお知らせ").alias("text"))
    return checks.counter_evidence(parameters, found)


@query("""WITH p AS (SELECT p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0 END AS c, CASE WHEN p_partkey % 97 <> 0 THEN 1 END AS central, CASE WHEN p_partkey % 40 = 0 THEN 1 ELSE 0 END AS severe, CASE WHEN p_brand < 'Brand#2' THEN 'consistent' WHEN p_brand < 'Brand#4' THEN 'discrepant' ELSE 'incompatible' END AS agreement FROM part),
g AS (SELECT p_brand, coalesce(avg(c), 0.2e0) AS m, count(*) - count(central) AS missing, sum(severe) AS severe, any_value(agreement) AS a FROM p GROUP BY 1)
SELECT p_brand, round(least(greatest(m - CASE WHEN missing > 0 THEN 0.2e0 ELSE 0e0 END - least(0.05e0 * severe, 0.2e0) + CASE a WHEN 'consistent' THEN 0.05e0 WHEN 'discrepant' THEN -0.15e0 ELSE 0e0 END, 0.05e0), 0.95e0) + 1e-9, 2) AS confidence FROM g""")
def confidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_brand", F.when(k % 3 != 0, F.col("p_size") / 50.0).alias("c"), F.when(k % 97 != 0, 1).alias("central"), F.when(k % 40 == 0, 1).otherwise(0).alias("severe"), F.when(F.col("p_brand") < "Brand#2", "consistent").when(F.col("p_brand") < "Brand#4", "discrepant").otherwise("incompatible").alias("agreement"))
    return checks.confidence(rows, "p_brand", "c", "central", "severe", "agreement")


@query("""WITH s AS (SELECT p_brand, p_partkey, round(0.2e0 * (p_size / 50.0e0) + 0.2e0 * (p_partkey % 2) + 0.15e0 * 0.5e0 + 0.2e0 * (p_partkey % 3 / 2.0e0) + 0.1e0 * 0.7e0 + 0.05e0 * (p_partkey % 5 / 4.0e0) + 0.1e0 + 1e-9, 3) AS score FROM part)
SELECT *, CASE row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) WHEN 1 THEN 'primary' WHEN 2 THEN 'check' ELSE 'other' END AS use FROM s""")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    criteria = {"estimability": F.col("p_size") / 50.0, "unit_consistency": (k % 2).cast("double"), "explainability": F.lit(0.5), "evidence_availability": (k % 3) / 2.0, "double_counting_risk": F.lit(0.7), "dependency_risk": (k % 5) / 4.0, "independence": F.lit(1.0)}
    rows = table(spark, d, "part").select("p_brand", "p_partkey", *(v.alias(c) for c, v in criteria.items()))
    return checks.model_scores(rows, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "score", "use")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spent, count(*) OVER w <= 5 AND sum(o_totalprice) OVER w <= 500000 AS fits FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def search_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return checks.within_budget(rows, "o_custkey", "at", "o_totalprice", 5, 500000.0).select("o_orderkey", F.round("spent", 2).alias("spent"), "fits")


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS tokens, CASE WHEN event_type = 'error' THEN value END AS cost FROM events)
SELECT user_id, arg_max(tokens, event_id) FILTER (tokens IS NOT NULL) AS tokens, arg_max(cost, event_id) FILTER (cost IS NOT NULL) AS cost, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'click') AS sources FROM e GROUP BY user_id""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(kind == "view", "search").when(kind == "click", "source_found").otherwise(kind).alias("kind"), F.when(kind == "purchase", F.col("value")).alias("tokens"), F.when(kind == "error", F.col("value")).alias("cost"))
    return checks.run_metrics(rows, "user_id", "event_id", "kind", ["tokens", "cost"])


@query(r"""WITH h AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '://([^/?#:]*)', 1), '\.+$', '') AS host FROM pages)
SELECT page_id, host <> '' AND (regexp_matches(host, '(^|\.)(twitter\.com|x\.com|facebook\.com|reddit\.com|note\.com)$') OR regexp_matches(host, '5ch|blog|bbs|forum|ameblo|hatenablog|livedoor')) AS social,
regexp_matches(host, 'ministry|^www') AND NOT (host LIKE '%.com' OR page_id % 4 = 0) AS unverified FROM h""")
def host_checks(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), "://([^/?#:]*)", 1)
    primary = F.when(F.col("page_id") % 4 == 0, "data.example.com").otherwise("")
    return table(spark, d, "pages").select("page_id", checks.social_host(host).alias("social"), checks.unverified(host, host, primary, "ministry|^www", [".com"]).alias("unverified"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def claims_of_succeeded(spark: SparkSession, d: str) -> DataFrame:
    found = checks.succeeded(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, d, "orders"), "o_orderkey", "o_orderstatus", "F")
    return found.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "o_custkey")


@query("""SELECT url, CAST(page_id AS VARCHAR) AS title, false AS from_evidence FROM (SELECT min(page_id) AS page_id, url FROM pages WHERE page_id % 2 = 0 GROUP BY url)
UNION ALL SELECT DISTINCT url, NULL, true FROM pages WHERE page_id % 3 = 0 AND url <> '' AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)""")
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    sources = pages.where("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").cast("string").alias("title"))
    return checks.with_sources(pages.where("page_id % 3 = 0"), sources, "url", "title")


@query("""SELECT o_orderkey, coalesce(len(p), 0) AS lines, coalesce(array_to_string(p, ','), '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("at"), "l_linenumber", "l_partkey")
    found = checks.nested(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "at", ["l_linenumber", "l_partkey"], "lines")
    return found.select("o_orderkey", F.size("lines").cast("long").alias("lines"), F.array_join(F.transform("lines", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ",").alias("parts"))


@query("""WITH u AS (SELECT DISTINCT lang AS model, md5(text) AS item, source AS cluster, CASE WHEN n_chars % 3 = 0 THEN 'D' ELSE 'A' END AS cls FROM documents),
i AS (SELECT a.model AS a, b.model AS b, count(DISTINCT a.item) AS items, count(DISTINCT CASE WHEN a.cls = 'D' THEN a.item END) AS weak FROM u a JOIN u b ON a.item = b.item AND a.model < b.model GROUP BY ALL),
c AS (SELECT a.model AS a, b.model AS b, count(DISTINCT a.cluster) AS clusters FROM u a JOIN u b ON a.cluster = b.cluster AND a.model < b.model GROUP BY ALL)
SELECT a, b, coalesce(items, 0) AS items, coalesce(clusters, 0) AS clusters, coalesce(weak, 0) AS weak FROM i FULL JOIN c USING (a, b)""")
def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "documents").select(F.col("lang").alias("model"), F.md5("text").alias("item"), F.col("source").alias("cluster"), F.when(F.col("n_chars") % 3 == 0, "D").otherwise("A").alias("cls")).distinct()
    return checks.shared_evidence(uses, "model", "item", "cluster", "cls", ["C", "D", "E"]).select("a", "b", "items", "clusters", "weak")


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'F') / count(*) AS coverage FROM orders GROUP BY 1""")
def status_coverage(spark: SparkSession, d: str) -> DataFrame:
    return checks.status_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("""WITH s AS (SELECT source, n_chars % 5 AS size, sum(length(text)) AS chars FROM documents GROUP BY ALL) SELECT source, arg_min(size, (-chars, size)) AS size FROM s GROUP BY source""")
def body_size(spark: SparkSession, d: str) -> DataFrame:
    return checks.body_size(table(spark, d, "documents").withColumn("size", F.col("n_chars") % 5), "source", "size", "text")


FRONT = """WITH f AS (SELECT source, lang, CAST(max(n_chars) % 50 AS DOUBLE) AS score FROM documents GROUP BY ALL), w AS (SELECT source, score, score >= max(score) OVER (PARTITION BY lang) - 1e-9 AS won FROM f), r AS (SELECT source, count(*) FILTER (won) AS wins, avg(score) AS agg FROM w GROUP BY source)"""


@query(FRONT + " SELECT source, wins, round(agg, 6) AS agg, (row_number() OVER (ORDER BY wins DESC, agg DESC, source) - 1) = 7 % (SELECT count(*) FROM r) AS next FROM r")
def front_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Sources as candidates, languages as chapters; the seventh turn's parent is marked."""
    front = table(spark, d, "documents").groupBy("source", "lang").agg((F.max("n_chars") % 50).cast("double").alias("score"))
    ranked = checks.front_wins(front, "source", "lang", "score")
    parent = checks.next_parent(ranked, [F.desc("wins"), F.desc("agg"), F.asc("source")], 7).select("source", F.lit(True).alias("next"))
    return ranked.join(parent, "source", "left").select("source", "wins", F.round("agg", 6).alias("agg"), F.coalesce("next", F.lit(False)).alias("next"))


@query("""WITH c AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS after FROM events GROUP BY 1), n AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS k FROM events e JOIN c USING (user_id) WHERE event_id > after)
SELECT user_id, event_id FROM n WHERE k <= 20""")
def after_cursor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    cursors = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("after"))
    return checks.after_cursor(rows, "user_id", "event_id", cursors, 20).select("user_id", "event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    return checks.latest(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100).select("o_orderkey", "o_orderstatus")


@query("""SELECT lang, count(DISTINCT md5(text)) AS texts, count(DISTINCT source) AS sources, min(coalesce(n_chars, doc_id)) AS first, max(coalesce(n_chars, doc_id)) AS last, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS calls FROM documents GROUP BY lang""")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents of a collection, ends of its time, and totals of use."""
    at = F.coalesce("n_chars", "doc_id")
    return table(spark, d, "documents").groupBy("lang").agg(F.countDistinct(F.md5("text")).alias("texts"), F.countDistinct("source").alias("sources"), F.min(at).alias("first"), F.max(at).alias("last"), F.sum("n_chars").alias("chars"), F.count("*").alias("calls"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS active FROM orders GROUP BY 1 HAVING active > 0""")
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_custkey").agg(F.count("*").alias("active"))


@query("""SELECT p_partkey, p_size % 9 <> 0 AS has_expression, p_size % 4 <> 0 AS no_cycle, p_size % 9 <> 0 AND p_size % 5 <> 0 AS expression_valid, p_size + 1 <= 15 AS within_leaf_limit, p_size % 3 <> 0 AS observable, true AS few_children FROM part""")
def decomposition_checks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as parameters that split into a daily value and days."""
    size = F.col("p_size")
    me = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    child = lambda name, terms: F.struct(name.alias("id"), terms.alias("terms"))
    daily = F.when(size % 4 == 0, me).otherwise(F.concat(me, F.lit("_daily")))
    children = F.array(child(daily, F.array(F.lit("daily"))), child(F.concat(me, F.lit("_days")), F.when(size % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("days")))))
    expression = F.when(size % 9 == 0, " ").otherwise(F.concat(daily, F.lit(" * "), F.when(size % 5 == 0, F.lit("other")).otherwise(F.concat(me, F.lit("_days")))))
    rows = table(spark, d, "part").select("p_partkey", me.alias("id"), expression.alias("expression"), children.alias("children"), F.array(F.lit("other")).alias("known"), F.col("p_size").alias("leaves"))
    return checks.decomposition_checks(rows, "id", "expression", "children", "known", "leaves").withColumn("p_partkey", F.substring("id", 2, 20).cast("long")).drop("id")


@query("""SELECT p_partkey, p_partkey || '_daily * ' || p_partkey || '_working_days' AS expression, 'item/(person*day)' AS daily FROM part WHERE p_size / 50.0 >= 0.6 AND p_retailprice / 2000 >= 0.4 AND p_partkey % 4 < 3 AND p_partkey % 2 = 0""")
def annual_decomposition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") / 50.0).alias("severity"), (F.col("p_retailprice") / 2000).alias("importance"), (F.col("p_partkey") % 4).alias("depth"), F.when(F.col("p_partkey") % 2 == 0, "item / (person * year)").otherwise("item/year").alias("unit"))
    found = checks.annual_capacity(checks.to_decompose(rows, "severity", "importance", "depth"), "id", "unit")
    return found.select(F.col("id").cast("long").alias("p_partkey"), "expression", F.col("children")[0]["unit"].alias("daily"))


@query(r"""SELECT conv_id, turn, md5('<<<UNTRUSTED-DOCUMENT-' || conv_id || '>>>' || chr(10) || replace(coalesce(text, '')[1:20000], 'UNTRUSTED-DOCUMENT', 'UNTRUSTED-DOC-ESCAPED') || chr(10) || '<<<END-UNTRUSTED-DOCUMENT-' || conv_id || '>>>') AS bounded_md5,
CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 'empty' WHEN length(text) > 400 THEN 'too long' WHEN contains(text, 'the') THEN 'banned: the' END AS refused,
lower(regexp_replace(coalesce(text, ''), '[\s、。,.　・:：/／()（）「」"'']+', '', 'g'))[1:50] AS bare FROM conversations""")
def safe_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(safety.bounded("text", F.col("conv_id").cast("string"))).alias("bounded_md5"), safety.guard("text", 400, ["the"]).alias("refused"), F.substring(safety.bare_text("text"), 1, 50).alias("bare"))


@query(r"""WITH j AS (SELECT doc_id, CAST(regexp_matches(text, '[+\-]?\d[\d,\.]*\s*(%|倍|件|億|万|人|社)') AS INT) AS n, CAST(l.doc_id IS NOT NULL AS INT) AS cited FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
s AS (SELECT doc_id, 0.5 AS coverage, round(0.35 + 0.4 * n, 3) AS specificity, round(0.2 + 0.65 * cited, 3) AS evidence FROM (SELECT d.doc_id, CAST(regexp_matches(text, '[+\-]?\d[\d,\.]*\s*(%|倍|件|億|万|人|社)') AS INT) AS n, CAST(l.doc_id IS NOT NULL AS INT) AS cited FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id))
SELECT doc_id, CAST(specificity AS DOUBLE) AS specificity, CAST(evidence AS DOUBLE) AS evidence, round(0.3 * 0.5 + 0.3 * specificity + 0.25 * evidence + 0.15 * 0.7, 3) AS score FROM s""")
def rule_judge(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("cited", F.lit(True))
    rows = table(spark, d, "documents").join(labelled, "doc_id", "left")
    judged = safety.judged("text", F.coalesce("cited", F.lit(False)))
    return rows.select("doc_id", judged.alias("j")).select("doc_id", "j.specificity", "j.evidence", "j.score")


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL QUALIFY k <= 4)
SELECT conv_id, md5(string_agg('[S' || k || '] ' || role || ': ' || text[1:400], chr(10) || chr(10) ORDER BY k)) AS answer_md5 FROM r GROUP BY conv_id""")
def extract_answers(spark: SparkSession, d: str) -> DataFrame:
    return safety.extracts(table(spark, d, "conversations").where("text IS NOT NULL"), "conv_id", "turn", "role", "text").select("conv_id", F.md5("answer").alias("answer_md5"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script)\b.*?</script\s*>|<(style)\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(meta|link|base)\b[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(p|div|br|tr|li|h1|h2|h3|h4|table)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM h),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM e""")
def tree_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(safety.tree_text("html")).alias("text_md5"))


@query()
def displayable_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(safety.displayable("html")).alias("html_md5"))


@query("""WITH p AS (SELECT *, lag(p_partkey) OVER w AS k, lag(p_name) OVER w AS name, lag(p_size) OVER w AS size, lag(p_size // 10) OVER w AS mfgr, lag(p_size % 4) OVER w AS c, lag(p_type) OVER w AS t FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
d AS (SELECT p_partkey, list_filter([CASE WHEN lower(replace(p_name, ' ', '')) <> lower(replace(name, ' ', '')) THEN 'definition' END, CASE WHEN p_size <> size THEN 'time' END, CASE WHEN p_size // 10 <> mfgr THEN 'geography' END, CASE WHEN (p_partkey % 3 = 0) <> (k % 3 = 0) THEN 'method' WHEN p_partkey % 3 <> 0 AND k % 3 <> 0 AND p_size % 4 <> c THEN 'method' END, CASE WHEN lower(replace(p_type, ' ', '')) <> lower(replace(t, ' ', '')) THEN 'population' END], lambda x: x IS NOT NULL) AS d FROM p WHERE k IS NOT NULL)
SELECT p_partkey, CASE WHEN len(d) = 0 THEN 'unknown' ELSE array_to_string(d, ',') END AS differs FROM d""")
def pair_differences(spark: SparkSession, d: str) -> DataFrame:
    """Each part against the one before of its brand."""
    own = F.struct(F.col("p_name").alias("definition"), F.col("p_size").alias("year"), F.floor(F.col("p_size") / 10).cast("string").alias("geography"), F.when(F.col("p_partkey") % 3 != 0, (F.col("p_size") % 4).cast("string")).alias("method"), F.col("p_type").alias("population"))
    rows = table(spark, d, "part").select("p_brand", "p_partkey", own.alias("own"))
    rows = rows.withColumn("other", F.lag("own").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("other IS NOT NULL")
    return rows.select("p_partkey", F.array_join(safety.differences(F.col("own"), F.col("other")), ",").alias("differs"))


@query("""SELECT user_id, md5(string_agg(repeat('  ', CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) || event_type, chr(10) ORDER BY event_id)) AS tree_md5 FROM events GROUP BY user_id""")
def tree_lines(spark: SparkSession, d: str) -> DataFrame:
    depth = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return safety.tree_lines(table(spark, d, "events").withColumn("depth", depth), "user_id", "event_id", "depth", "event_type").select("user_id", F.md5("tree").alias("tree_md5"))


@query("""SELECT conv_id, turn, 'c' || conv_id AS ref, role AS title, text[1:200] AS snippet, round(turn / 7.0, 4) AS score FROM conversations""")
def chunk_citations(spark: SparkSession, d: str) -> DataFrame:
    c = safety.citation(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("role"), F.col("text"), F.col("turn") / 7.0)
    return table(spark, d, "conversations").select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.*")


@query("""SELECT doc_id, n_chars, CAST(n_chars AS DOUBLE) AS value, 'event' AS unit, CASE WHEN n_chars BETWEEN 1 AND 90000 THEN 1.0 END AS low, CASE WHEN n_chars BETWEEN 1 AND 90000 THEN 90000.0 END AS high FROM documents""")
def numbers_near(spark: SparkSession, d: str) -> DataFrame:
    """The number next to a document's length in a text that is given one; the rest of the text has its own numbers."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nthe total length is 約"), "n_chars", F.lit("件 (range 1 - 90000)"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", text.alias("text"))
    asked = spark.createDataFrame([("length", ["total length"], ["event"])], "parameter string, aliases array<string>, expected array<string>")
    near = extraction.numbers_by_alias(docs, asked, "doc_id", "text")
    return docs.select("doc_id", "n_chars").join(near, "doc_id", "left").select("doc_id", "n_chars", "value", "unit", "low", "high")


@query("""WITH t AS (SELECT doc_id, doc_id % 3 = 0 AS tabled, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'size' AS parameter, CAST(n AS DOUBLE) AS value, 'item' AS unit, 'table' AS method, 1 AS row, 2 AS "column", NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM t WHERE tabled
UNION ALL SELECT doc_id, 'size', n + 1.0, 'item', 'text', 0, 0, NULL, NULL FROM t WHERE NOT tabled
UNION ALL SELECT doc_id, 'homes', n * 10000.0 + 2000, 'household', 'text', 0, 0, NULL, NULL FROM t WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'share', 2.5, '', 'text', 0, 0, 1.5, 4.0 FROM t WHERE doc_id % 5 = 0""")
def document_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that documents name, in a table or behind their texts; a labelled line of the source and numbers of other units don't count."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("n", F.length("text"))
    said = F.concat(F.lit("\n" + "." * 150 + "\nstored pieces count "), (F.col("n") + 1).cast("string"), F.lit("台 in 7 days\n"))
    homes = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("." * 150 + "\n世帯数は3件以上、"), F.col("n").cast("string"), F.lit("万2千世帯\n調査方法: 世帯数 99世帯\n"))).otherwise("")
    share = F.when(F.col("doc_id") % 5 == 0, "." * 150 + "\nLoanword ratio 2.5 (1.5 - 4.0)").otherwise("")
    header = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("年"), F.lit("stored pieces")))
    rows = F.when(F.col("doc_id") % 3 == 0, F.array(F.array(F.lit("2024"), F.concat(F.col("n").cast("string"), F.lit("台")))))
    docs = docs.select("doc_id", F.concat("text", said, homes, share).alias("text"), header.alias("header"), rows.alias("rows"))
    asked = [("size", ["stored pieces", "pieces"], ["item"]), ("homes", ["世帯数"], ["household"]), ("share", ["loanword ratio"], [""]), ("none", ["unheard-of parameter"], ["day"])]
    found = extraction.evidence(docs, spark.createDataFrame(asked, "parameter string, aliases array<string>, expected array<string>"), "doc_id")
    return found.drop("at", "excerpt").fillna(0, ["row", "column"])
