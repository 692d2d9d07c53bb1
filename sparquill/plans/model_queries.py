"""Queries of fronts over many axes, nested JSON, units and formulas as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import questions
from ..operators import evidence, nested, retrieval, rewriting, search, simulation, statistics, templates, units
from ..sources import versions
from ..sources.tables import spread, stage_path, table
from ..streaming import breakers, events
from .queries import _brands, query

DOMINATED = " AND ".join(f"a.{x} >= b.{x} - 1e-9" for x in "wxyz"), " OR ".join(f"a.{x} > b.{x} + 1e-9" for x in "wxyz")


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, p_retailprice AS x, CAST(-(p_partkey % 97) AS DOUBLE) AS y, CAST(length(p_name) AS DOUBLE) AS z FROM part)
SELECT p_partkey, w, x, y, z FROM p b WHERE NOT EXISTS (SELECT 1 FROM p a WHERE {DOMINATED[0]} AND ({DOMINATED[1]}))""")
def part_front(spark: SparkSession, d: str) -> DataFrame:
    """Parts that none beats in size, price, a falling code and the length of the name at once."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), F.col("p_retailprice").alias("x"), (-(F.col("p_partkey") % 97)).cast("double").alias("y"), F.length("p_name").cast("double").alias("z"))
    return evidence.front(p, ["w", "x", "y", "z"])


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN 'top ' || event_type ELSE CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS report,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id + CAST(json_extract(props, '$.k') AS DOUBLE) END AS tokens_in, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 2.0 END AS tokens_out FROM events""")
def nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A report and token counts somewhere inside each event's nested JSON: the report is sometimes at the top, deep, or below the depth that is searched;
    counts come under two names, and as text, which doesn't count."""
    kind = F.col("event_id") % 4
    used = F.when(F.col("event_id") % 3 != 0, F.format_string('{"usage_metadata": {"input_tokens": %d, "completion_tokens": 2, "usage_metadata": {"input_tokens": 9}}}, {"x": {"usage_metadata": {"prompt_tokens": %d, "output_tokens": "7"}}}', "user_id", F.get_json_object("props", "$.k").cast("long")))
    report = F.when(kind == 0, F.format_string('"k": "top %s", ', "event_type")).otherwise('"k": null, ')
    deep = F.when(kind == 3, F.concat(F.lit('[[[[[[[{"v": '), "props", F.lit("}]]]]]]]"))).otherwise(F.concat(F.lit('{"z": ['), "props", F.lit(', {"k": "later"}]}')))
    json = F.concat(F.lit("{"), report, F.lit('"deep": '), deep, F.lit(', "messages": [1, null, '), F.coalesce(used, F.lit('"none"')), F.lit("]}"))
    rows = spread(table(spark, d, "events").select("event_id", "event_type", "user_id", "props")).select("event_id", json.alias("json"))
    fields = {"tokens_in": ("input_tokens", "prompt_tokens"), "tokens_out": ("output_tokens", "completion_tokens")}
    sums = nested.totals(rows, "event_id", "json", "usage_metadata", fields)
    return sums.join(nested.first_under(rows, "event_id", "json", "k").withColumnRenamed("value", "report"), "event_id", "left")


@query("""WITH u(k, unit, wanted, factor, dims) AS (VALUES (0, '件/(台*年)', 'event/item/day', 1 / 365.25, 'item:-1,event:1,time:-1'), (1, '億円/社', 'man_yen/company', 10000.0, 'JPY:1,company:-1'), (2, 'km**2', 'm*m', 1e6, 'length:2'),
(3, 'percent', '割', 0.1, ''), (4, 'item/person', 'item/household', NULL, 'person:-1,item:1'), (5, 'parsec', 'km', NULL, NULL), (6, 'JPY/(person·month)^-1', 'person*month*yen', 1.0, 'person:1,JPY:1,time:1'))
SELECT event_id, CAST(round(value * factor, 9) AS DOUBLE) AS converted, dims AS dimensions, coalesce(k IN (6), false) AS directly FROM events JOIN u ON event_id % 7 = k""")
def converted_values(spark: SparkSession, d: str) -> DataFrame:
    """Events' values in compound units, converted, with their dimensions; some units are unknown or of another kind."""
    pairs = [("件/(台*年)", "event/item/day"), ("億円/社", "man_yen/company"), ("km**2", "m*m"), ("percent", "割"), ("item/person", "item/household"), ("parsec", "km"), ("JPY/(person·month)^-1", "person*month*yen")]
    kind = (F.col("event_id") % len(pairs)).cast("int")
    unit, wanted = (F.get(F.array(*(F.lit(p[k]) for p in pairs)), kind) for k in (0, 1))
    rows = table(spark, d, "events").select("event_id", "value", unit.alias("unit"), wanted.alias("wanted"))
    own, other = units.vector(F.col("unit")), units.vector(F.col("wanted"))
    value = F.round(units.converted(F.col("value"), F.col("unit"), F.col("wanted")), 9)
    return rows.select("event_id", value.alias("converted"), units.dimension_text(own).alias("dimensions"), F.coalesce(units.same(own, other), F.lit(False)).alias("directly"))


@query("""WITH m AS (SELECT p_partkey AS model, p_partkey % 6 AS k, CAST(p_size AS VARCHAR) AS n FROM part)
SELECT model, CASE k WHEN 0 THEN n || ' * (boxes * pieces) * (price - rebate)' WHEN 1 THEN n || ' * (boxes + pieces) * (price - rebate)' WHEN 4 THEN '-(price - rebate) * pieces / ' || n || ' ** 2' ELSE n || ' * sold * (price - rebate)' END AS formula,
k IN (0, 4, 5) AS accepted, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'other scale' WHEN 3 THEN 'no formula' END AS reason FROM m WHERE k <> 1
UNION ALL SELECT model, n || ' * sold * (price - rebate)', false, 'units of a sum differ' FROM m WHERE k = 1""")
def rewritten_models(spark: SparkSession, d: str) -> DataFrame:
    """A revenue formula for each part, whose sold pieces are replaced by another formula; wrong units, scales and texts are refused."""
    kind = (F.col("p_partkey") % 6).cast("int")
    n = F.col("p_size").cast("string")
    base = F.concat(n, F.lit("*sold*(price - rebate)"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("model"), kind.alias("k"), F.when(kind == 4, F.concat(F.lit("-(price-rebate)*sold/"), n, F.lit("**2"))).otherwise(base).alias("formula"), F.lit("JPY/day").alias("wanted"))
    shapes = {0: "boxes*pieces", 1: "boxes + pieces", 2: "yearly", 3: "boxes **", 4: "pieces"}
    given = F.create_map(*(F.lit(x) for p in shapes.items() for x in p))
    put = parts.select("model", F.lit("sold").alias("name"), F.try_element_at(given, F.col("k")).alias("formula"), "k").where("formula IS NOT NULL")
    said = {"price": "円/台", "rebate": "yen/item", "sold": "item/day", "yearly": "item/year", "boxes": "event/day", "pieces": "item/event"}
    named = parts.select("model", "k", F.explode(F.create_map(*(F.lit(x) for p in said.items() for x in p))).alias("name", "unit"))
    named = named.withColumn("unit", F.when((F.col("k") == 4) & (F.col("name") == "pieces"), "item/day").otherwise(F.col("unit"))).drop("k")
    return rewriting.rewritten(parts.drop("k"), put.drop("k"), named)


@query("""WITH b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS pl, quantile_cont(p_retailprice, 0.5) AS pm, quantile_cont(p_retailprice, 0.9) AS ph, avg(p_size) AS s, count(*) AS n, quantile_cont(p_retailprice / p_size, 0.1) AS q1, quantile_cont(p_retailprice / p_size, 0.5) AS q5, quantile_cont(p_retailprice / p_size, 0.9) AS q9 FROM part GROUP BY 1),
r AS (SELECT p_brand, unnest(['bear', 'base', 'bull', 'extreme_low', 'extreme_high', 'custom']) AS kind, unnest([q1, q5, q9, pl * 0.9 * n / (1.3 * s), ph * 1.2 * n / (0.8 * s), 2 * pm * n / s]) AS value FROM b) SELECT p_brand, kind, round(value + 1e-7, 4) AS value FROM r""")
def brand_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of a brand's price * count / size: quantiles of the parts' own prices by size, extremes by direction, and a doubled price."""
    parts = table(spark, d, "part").withColumn("y", F.try_divide("p_retailprice", "p_size"))
    results = statistics.quantiles(parts, ["p_brand"], "y", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    found = simulation.scenarios(_brands(spark, d), "p_brand", "price * count / size", ["price", "size", "count"], results, {"price": F.col("price_mid") * 2})
    return found.withColumn("value", F.round(F.col("value") + 1e-7, 4))


@query("""WITH q(k, place, period, kind, unit, assumed) AS (VALUES (0, '東京都', '', 'stock', 'person', ''), (1, '日本', '1年間', 'flow', 'JPY', 'place'), (2, '日本', '1日', 'flow', 'event', 'unit'), (3, '横浜市', '', 'stock', 'item', ''), (4, '日本', '', 'stock', 'event', 'place,year,kind,unit'))
SELECT event_id, place, CASE WHEN k = 4 THEN '2026' ELSE CAST(1990 + user_id % 30 AS VARCHAR) END AS year, period, kind, unit, assumed FROM events JOIN q ON event_id % 5 = k""")
def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions about events' users, what they ask for, and what has to be assumed."""
    year = (1990 + F.col("user_id") % 30).cast("string")
    shapes = [F.concat(year, F.lit("年の東京都にピアノ調律師は何人いる?")), F.concat(year, F.lit("年の傘の年間売上はいくら")), F.concat(F.lit("全国で1日に捨てられる傘は、"), year, F.lit("年")), F.concat(F.lit("横浜市の車の台数は"), year, F.lit("年")), F.col("event_type")]
    question = F.get(F.array(*shapes), (F.col("event_id") % 5).cast("int"))
    asked = table(spark, d, "events").select("event_id", questions.asked(question).alias("a"))
    return asked.select("event_id", "a.place", "a.year", "a.period", "a.kind", "a.unit", F.array_join("a.assumed", ",").alias("assumed"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'second' ELSE 'first' END AS run, CASE WHEN doc_id % 2 = 0 THEN source END AS summary,
CASE WHEN doc_id % 5 = 0 THEN 1 ELSE len(string_split(text, chr(10))) END AS pieces, CAST(length(text) - CASE WHEN doc_id % 5 = 0 THEN 0 ELSE len(string_split(text, chr(10))) - 1 END AS BIGINT) AS chars,
coalesce((SELECT count(*) FROM embeddings WHERE vec_id = doc_id AND embedding IS NOT NULL), 0) AS vectors FROM documents WHERE text IS NOT NULL""")
def published_ingests(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken in as lines, every fifth again as a whole without its summary, every third once more by a run that is cut short and cleaned up."""
    path = stage_path(spark)
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    lines = lambda rows, sep: rows.select("doc_id", F.posexplode(F.split("text", sep)).alias("place", "text"))
    vectors = table(spark, d, "embeddings").where("embedding IS NOT NULL").withColumnRenamed("vec_id", "doc_id").drop("label")
    summary = F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("summary")
    names = [versions.HEADS, "pieces", "vectors"]
    for run, rows, sep, said in (("first", docs, "\n", summary), ("second", docs.where("doc_id % 5 = 0"), "(?!)", F.lit(None).cast("string").alias("summary")), ("third", docs.where("doc_id % 3 = 0"), " ", summary)):
        versions.write({versions.HEADS: rows.select("doc_id", said), "pieces": lines(rows, sep), "vectors": vectors.join(rows.select("doc_id"), "doc_id", "left_semi")}, path, run)
        if run != "third":
            versions.publish(spark, path, run, names)
    versions.clean_up(spark, path, names)
    heads = versions.read(spark, path, versions.HEADS, "doc_id", keep=["summary"])
    pieces = versions.read(spark, path, "pieces", "doc_id").groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars"))
    counted = versions.read(spark, path, "vectors", "doc_id").groupBy("doc_id").agg(F.count("*").alias("vectors"))
    return heads.join(pieces, "doc_id", "left").join(counted, "doc_id", "left").fillna(0, ["vectors"])


@query("""WITH s AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000 AS last FROM events), w AS (SELECT *, lead(last) OVER (PARTITION BY key ORDER BY last) AS n, max(last) OVER () - 600000 AS mark FROM s)
SELECT key, make_timestamp(last * 1000) AS last FROM w WHERE (n IS NULL OR n - last > 43200000) AND last + 43200000 < mark""")
def silent_users(spark: SparkSession, d: str) -> DataFrame:
    """Times after which a user gave no sign for half a day."""
    beats = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("time"))
    return events.silences_in(beats, 43200, 600).withColumn("last", F.timestamp_millis("last").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'one/' || p_partkey ELSE p_brand || '/' || p_size % 8 END AS parameter, CASE WHEN p_partkey % 36 = 0 OR p_partkey % 61 = 0 THEN -p_retailprice WHEN p_partkey % 13 = 0 THEN p_retailprice * 100 ELSE p_retailprice END AS value, 30 + p_partkey % 60 AS w FROM part),
u AS (SELECT *, CASE WHEN id % 2 = 0 THEN value - 50 END AS lo, CASE WHEN id % 2 = 0 THEN value + 20000 END AS hi FROM e WHERE id % 5 <> 1),
f AS (SELECT parameter, quantile_cont(ln(value), 0.25) AS a, quantile_cont(ln(value), 0.75) AS b FROM u GROUP BY 1 HAVING count(*) >= 4 AND min(value) > 0),
k AS (SELECT u.*, count(*) OVER p AS n, min(value) OVER p > 0 AS positive, avg(w) OVER p AS mean FROM u LEFT JOIN f USING (parameter) WHERE a IS NULL OR value BETWEEN exp(a - 3 * (b - a)) AND exp(b + 3 * (b - a)) WINDOW p AS (PARTITION BY parameter)),
x AS (SELECT *, CASE WHEN positive AND n > 1 THEN ln(value) ELSE value END AS x FROM k),
c AS (SELECT *, (sum(w) OVER (PARTITION BY parameter ORDER BY x, id ROWS UNBOUNDED PRECEDING) - w / 2.0) / sum(w) OVER (PARTITION BY parameter) AS c FROM x),
q AS (SELECT parameter, q, max(c) FILTER (c <= q) AS ca, arg_max(x, c) FILTER (c <= q) AS va, min(c) FILTER (c > q) AS cb, arg_min(x, c) FILTER (c > q) AS vb FROM c, (VALUES (0.1), (0.5), (0.9)) t(q) GROUP BY ALL),
r AS (SELECT parameter, q, CASE WHEN ca IS NULL THEN vb WHEN cb IS NULL THEN va ELSE va + (vb - va) * (q - ca) / (cb - ca) END AS v FROM q),
g AS (SELECT parameter, any_value(n) AS n, bool_and(positive) AS positive, any_value(mean) AS mean, min(lo) AS lo, min(hi) AS hi FROM k GROUP BY 1),
h AS (SELECT parameter, n, positive, mean, lo, hi, max(CASE WHEN positive AND n > 1 THEN exp(v) ELSE v END) FILTER (q = 0.1) AS a, max(CASE WHEN positive AND n > 1 THEN exp(v) ELSE v END) FILTER (q = 0.5) AS m, max(CASE WHEN positive AND n > 1 THEN exp(v) ELSE v END) FILTER (q = 0.9) AS z FROM r JOIN g USING (parameter) GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 1 AND lo IS NOT NULL THEN lo WHEN n = 1 AND positive THEN m / 1.5 WHEN n = 1 THEN m - abs(m) / 2 WHEN positive AND z / a < 1.1 THEN m / 1.15 ELSE a END AS low, CASE WHEN n = 1 AND hi IS NOT NULL THEN hi WHEN n = 1 AND positive THEN m * 1.5 WHEN n = 1 THEN m + abs(m) / 2 WHEN positive AND z / a < 1.1 THEN m * 1.15 ELSE z END AS high FROM h)
SELECT parameter, coalesce(n, 0) AS n, round(low + 1e-7, 3) AS low, round(m + 1e-7, 3) AS central, round(high + 1e-7, 3) AS high, CASE WHEN NOT positive THEN 'triangular' WHEN low > 0 AND high / low > 10 THEN 'loguniform' WHEN n > 0 THEN 'lognormal' END AS distribution, CASE WHEN n > 0 THEN round(least(1, mean / 100 * (1 + 0.05 * (n - 1))), 3) END AS confidence FROM (SELECT DISTINCT parameter FROM e) LEFT JOIN s USING (parameter)""")
def parameter_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of many parts and of a single one, some negative, some without evidence that may be used."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    name = F.when(k % 9 == 0, F.concat(F.lit("one/"), k.cast("string"))).otherwise(F.concat("p_brand", F.lit("/"), (F.col("p_size") % 8).cast("string")))
    value = F.when((k % 36 == 0) | (k % 61 == 0), -price).when(k % 13 == 0, price * 100).otherwise(price)
    rows = table(spark, d, "part").select(k.alias("id"), name.alias("parameter"), value.alias("value"), (30 + k % 60).alias("w"))
    rows = rows.withColumns({"lo": F.when(F.col("id") % 2 == 0, F.col("value") - 50), "hi": F.when(F.col("id") % 2 == 0, F.col("value") + 20000)})
    found = statistics.estimates(rows, rows.where("id % 5 <> 1"), "parameter", "value", "w", "id", "lo", "hi")
    return found.select("parameter", "n", *(F.round(F.col(c) + 1e-7, 3).alias(c) for c in ("low", "central", "high")), "distribution", "confidence")


@query("""WITH r AS (SELECT lang AS question, 'title ' || doc_id % 40 AS title, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, doc_id % 40 AS t FROM documents WHERE lang IS NOT NULL),
b AS (SELECT question, title, min(k) AS k FROM r WHERE t <> 7 GROUP BY ALL) SELECT question, title, CAST(row_number() OVER (PARTITION BY question ORDER BY k) AS INT) AS rank FROM b QUALIFY rank <= 12""")
def located_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve titles of each language's documents by length; some documents share a title, some have none."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    title = F.when(F.col("doc_id") % 40 != 7, F.concat(F.lit("title "), (F.col("doc_id") % 40).cast("string"))).otherwise(" ")
    ranked = retrieval.top(docs.select(F.col("lang").alias("question"), "doc_id", "n_chars", title.alias("title")), ["question"], [F.desc("n_chars"), F.asc("doc_id")], 2**31 - 1)
    return search.titles(ranked, "title", 12)


@query("""WITH e AS (SELECT user_id % 12 AS key, event_id, epoch_us(ts) // 1000 AS ms, event_type <> 'purchase' AS bad, max(epoch_us(ts) // 1000) OVER () - 600000 AS mark FROM events),
r AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY key ORDER BY ms, event_id) AS run, min(CASE WHEN NOT bad THEN ms END) OVER (PARTITION BY key ORDER BY ms, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS good FROM e WHERE ms < mark),
n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ms, event_id) AS n FROM r WHERE bad), f AS (SELECT *, coalesce(ms > lag(ms) OVER (PARTITION BY key, run ORDER BY ms, event_id) + 3600000, true) AS fresh FROM n WHERE n >= 3),
p AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY key, run ORDER BY ms, event_id) AS part FROM f),
o AS (SELECT key, min(ms) AS opened, least(max(ms) + 3600000, min(good)) AS closed, CAST(count(*) AS INT) AS failures, any_value(mark) AS mark FROM p GROUP BY key, run, part)
SELECT key, make_timestamp(opened * 1000) AS opened, make_timestamp(closed * 1000) AS closed, failures FROM o WHERE closed < mark""")
def breaker_openings(spark: SparkSession, d: str) -> DataFrame:
    """When the circuits of twelve groups of users were open: three events in a row without a purchase open one, for an hour from the last of them."""
    calls = table(spark, d, "events").select((F.col("user_id") % 12).alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("time"), (F.col("event_type") != "purchase").alias("failed"))
    found = breakers.openings_in(calls, 3, 3600, 600)
    return found.withColumns({c: F.timestamp_millis(c).cast("timestamp_ntz") for c in ("opened", "closed")})


@query("""WITH q(k, subject, period, kind, unit) AS (VALUES (0, 'ピアノ調律師', '', 'stock', 'person'), (1, '傘', '1日', 'flow', 'item'), (2, '傘', '', 'stock', 'person'), (3, '電車整備士', '', 'stock', 'person'), (4, '充電器', '', 'stock', 'parsec')),
c(k, template, formula, wanted, fits, score, rank, units) AS (VALUES (0, 'maintenance_demand', 'base_households * ownership_rate * service_frequency / provider_capacity', 'person', true, 0.865, 1, 'household,piano/household,tuning/(piano*year),tuning/(person*year)'),
(0, 'association_supply', 'association_members / membership_rate', 'person', true, 0.81, 2, 'person,dimensionless'), (0, 'direct_lookup', 'direct_value', 'person', true, 0.663, 3, 'person'),
(1, 'population_ratio', 'population * applicable_rate * quantity_per_person', 'item/day', true, 0.762, 1, 'person,dimensionless,item/(person*day)'), (1, 'direct_lookup', 'direct_value', 'item/day', true, 0.663, 2, 'item/day'),
(2, 'population_ratio', 'population * applicable_rate', 'person', true, 0.762, 1, 'person,dimensionless'), (2, 'direct_lookup', 'direct_value', 'person', true, 0.663, 2, 'person'),
(3, 'maintenance_demand', 'base_households * ownership_rate * service_frequency / provider_capacity', 'person', true, 0.865, 1, 'household,vehicle/household,event/(vehicle*year),event/(person*year)'),
(3, 'association_supply', 'association_members / membership_rate', 'person', true, 0.81, 2, 'person,dimensionless'), (3, 'direct_lookup', 'direct_value', 'person', true, 0.663, 3, 'person'),
(4, 'population_ratio', 'population * applicable_rate * quantity_per_person', 'parsec', false, 0.562, 1, 'person,dimensionless,parsec/person'), (4, 'direct_lookup', 'direct_value', 'parsec', false, 0.463, 2, 'parsec')),
p AS (SELECT n_nationkey AS nation, count(c_custkey) AS people FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) > 0), s AS (SELECT count(*) FILTER (p_size > 25) / count(*) AS share, avg(p_size) AS each FROM part)
SELECT event_id, template, formula, wanted, fits, score, CAST(rank AS INT) AS rank, units, CAST(CASE WHEN template <> 'population_ratio' THEN 0 ELSE (people IS NOT NULL)::INT + (k < 4)::INT + (k = 1)::INT END AS BIGINT) AS known,
CASE WHEN template = 'population_ratio' AND k = 1 THEN round(people * share * each, 6) WHEN template = 'population_ratio' AND k = 2 THEN round(people * share, 6) END AS value
FROM events JOIN q ON event_id % 5 = q.k JOIN c USING (k) LEFT JOIN p ON p.nation = user_id % 25, s""")
def model_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Models for questions about nations, scored, and the values of those whose parameters the customers' and parts' tables know."""
    shapes = [("ピアノ調律師", "", "stock", "person"), ("傘", "1日", "flow", "item"), ("傘", "", "stock", "person"), ("電車整備士", "", "stock", "person"), ("充電器", "", "stock", "parsec")]
    k = (F.col("event_id") % len(shapes)).cast("int")
    given = {n: F.get(F.array(*(F.lit(s[i]) for s in shapes)), k) for i, n in enumerate(("subject", "period", "kind", "unit"))}
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    asked = table(spark, d, "events").withColumns(given).join(nations, F.col("user_id") % 25 == F.col("n_nationkey"), "left")
    people = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("place").agg(F.count("*").cast("double").alias("value"))
    size = table(spark, d, "part").agg((F.count_if(F.col("p_size") > 25) / F.count("*")).alias("share"), F.avg("p_size").alias("each"))
    facts = size.select(F.explode(F.create_map(F.lit("傘の該当率"), "share", F.lit("該当者1人あたり数量(日次)"), "each")).alias("name", "value"))
    known = people.select(F.concat("place", F.lit("の人口")).alias("name"), "value").unionByName(facts)
    found = templates.answered(templates.candidates(asked, "event_id"), known)
    units_ = F.array_join(F.transform("parameters", lambda p: p["unit"]), ",").alias("units")
    return found.select(F.col("key").alias("event_id"), "template", "formula", "wanted", "fits", "score", "rank", units_, "known", F.round("value", 6).alias("value"))
