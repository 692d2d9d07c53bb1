"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from string import Template

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, bpe, decontaminate, licences, lines, mixing, quality, signatures, simhash, sitetree, suffixes, tokens, whitening
from .common import documents, new_path


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = docs.select("doc_id", found.alias("h"))
    n = decontaminate.n_hit(F.col("h"))
    return hits.select("doc_id", F.col("h.n_words").alias("n_words"), n.alias("n_hit"), F.size("h.items").cast("long").alias("n_items"), F.sha2(F.array_join("h.items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.strip_chunks(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("kept")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = licences.scan(docs, F.col("doc_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.col("text"))
    return found.withColumnRenamed("id", "doc_id")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.write(documents(spark, sf_dir), path := new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(spark, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), columns=("doc_id",))
    return mixed.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.strip_repeats(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.strip_copied(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", quality.verdict("text", trees).alias("q")).select("doc_id", *(f"q.{c}" for c in quality.COUNTS), "q.base_failed", "q.kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.Ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = documents(spark, sf_dir).select("doc_id", ranks.encoded("text").alias("ids"))
    return coded.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(ranks.decoded("ids"), 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_line_chunks, op3_token_file, op4_licences, op5_mix, op6_site_tree, op7_simhash, op8_suffix_array, op9_substrings, op10_quality, op11_ranked_search, op12_whitening, op13_byte_bpe)}


OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
least AS (SELECT x, min(doc_id) AS first FROM win GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM win JOIN least USING (x) WHERE first < doc_id),
out AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, len(coalesce(ks, [])) AS r, string_agg(v, ' ' ORDER BY k) FILTER (WHERE g IS NULL) AS t
  FROM (SELECT d.doc_id, d.w, out.ks, u.k, d.w[u.k] AS v, gone.k AS g FROM d LEFT JOIN out USING (doc_id) LEFT JOIN (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k FROM d) u ON u.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.k = u.k) GROUP BY doc_id, w, ks)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""


OP2 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS k FROM d),
h AS (SELECT *, CAST('0x' || md5(line)[1:8] AS BIGINT) AS h FROM l),
e AS (SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % 3 <> 0 AS e FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
n AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, min(k) AS x, max(k) + 1 AS y FROM n GROUP BY doc_id, chunk),
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM c),
s AS (SELECT doc_id, x AS a, y AS b FROM p
  UNION ALL SELECT doc_id, x - n, x + 1 FROM (SELECT *, unnest(range(1, least(8, x - before) + 1)) AS n FROM p WHERE before IS NOT NULL)
  UNION ALL SELECT doc_id, x - 1, x + n FROM (SELECT *, unnest(range(2, least(8, y - x - 1) + 1)) AS n FROM p WHERE before IS NOT NULL)),
f AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(w[a:b - 1], chr(10)) ORDER BY doc_id, a) > 1 AS gone FROM s JOIN d USING (doc_id)
  WHERE len(list_filter(w[a:b - 1], lambda v: regexp_matches(v, '[^\x20\x09-\x0D]'))) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS k FROM f WHERE gone),
o AS (SELECT n.doc_id, count(*) AS n_lines, count(DISTINCT chunk) AS n_chunks, count(g.k) AS n_removed_lines, string_agg(line, chr(10) ORDER BY n.k) FILTER (WHERE g.k IS NULL) AS kept
  FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.k = n.k GROUP BY n.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN o USING (doc_id)
"""

OP4 = r"""
WITH t(licence, passage, body) AS (VALUES $PASSAGES), stop AS (SELECT unnest([$COMMON]) AS term), apart(licence, must, never) AS (VALUES $APART),
tt AS (SELECT licence, passage, term, count(*) AS tf FROM (SELECT licence, passage, unnest(regexp_extract_all(lower(body), '$WORDS')) AS term FROM t) WHERE term NOT IN (FROM stop) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + $N) / (1.0 + count(*))) + 1.0 AS idf FROM tt GROUP BY term),
w AS (SELECT licence, passage, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY passage)) AS w FROM tt JOIN idf USING (term)),
p AS (SELECT doc_id, text, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, concat_ws('/', source, lang) AS dir FROM documents),
l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS lines FROM p WHERE list_has_any(regexp_extract_all(lower(text), '$WORDS'), [$NEEDED])),
i AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
said AS (SELECT row_number() OVER () AS place, * FROM (SELECT doc_id, i, 1 AS n, unnest(string_split(regexp_replace(lines[i], '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1))) AS body FROM i
  UNION ALL SELECT doc_id, i, n, array_to_string(lines[i:i + n - 1], ' ') FROM i, (SELECT unnest([$WINDOWS]) AS n) WHERE i + n - 1 <= len(lines)) WHERE list_has_any(regexp_extract_all(body, '$WORDS'), [$NEEDED])),
tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(regexp_extract_all(body, '$WORDS')) AS term FROM said) WHERE term NOT IN (FROM stop) GROUP BY ALL),
v AS (SELECT tf.*, tf * coalesce(idf, ln(1.0 + $N) + 1.0) AS v FROM tf LEFT JOIN idf USING (term)),
n AS (SELECT place, sqrt(sum(v * v)) AS norm FROM v GROUP BY place),
near AS (SELECT place, licence, round(sum(v * w) / any_value(norm), 4) AS similarity FROM v JOIN w USING (term) JOIN n USING (place) GROUP BY place, licence, passage HAVING round(sum(v * w) / any_value(norm), 4) >= $LEAST),
fit AS (SELECT s.doc_id, s.i, s.n, similarity, licence FROM near JOIN said s USING (place) LEFT JOIN apart USING (licence) WHERE (coalesce(must, '') = '' OR regexp_matches(s.body, must)) AND (coalesce(never, '') = '' OR NOT regexp_matches(s.body, never))),
best AS (SELECT doc_id, max(similarity) AS similarity, arg_min(licence, (-similarity, licence)) AS top, list_distinct(list(licence)) AS every, list_distinct(flatten(list(range(i, i + n)))) AS hit FROM fit GROUP BY doc_id),
own AS (SELECT p.*, similarity, CASE WHEN top = 'BSD-2-Clause' AND list_contains(every, 'BSD-3-Clause') THEN 'BSD-3-Clause' ELSE top END AS own_licence, hit FROM p LEFT JOIN best USING (doc_id)),
sized AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS sizes FROM own WHERE own_licence IS NOT NULL),
files AS (SELECT dir, own_licence AS declared FROM sized WHERE 2 * list_sum(list_transform(hit, lambda k: sizes[k])) >= list_sum(sizes) OR regexp_matches(regexp_replace(path, '^.*/', ''), '$NAMED') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, own_licence) = 1),
found AS (SELECT own.doc_id, arg_max(files.dir, length(files.dir)) AS declared_in, arg_max(declared, length(files.dir)) AS declared FROM own JOIN files ON own.dir = files.dir OR starts_with(own.dir, files.dir || '/') OR files.dir = '' GROUP BY own.doc_id)
SELECT doc_id, path, own_licence, similarity, coalesce(own_licence, declared) AS licence, CASE WHEN own_licence IS NULL THEN declared_in END AS declared_in FROM own LEFT JOIN found USING (doc_id)
"""


OP11 = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n) AS l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 20
"""


def _op4() -> str:
    said = lambda v: "'" + v.replace("'", "''") + "'"
    passages = [(licence, body) for licence, bodies in licences.TEMPLATES.items() for body in bodies]
    rows = ", ".join(f"({said(licence)}, {k}, {said(body)})" for k, (licence, body) in enumerate(passages))
    apart = ", ".join(f"({said(licence)}, {said(must)}, {said(never)})" for licence, (must, never) in licences.APART.items())
    values = {"PASSAGES": rows, "APART": apart, "COMMON": ", ".join(map(said, sorted(licences.COMMON))), "WINDOWS": ", ".join(map(str, licences.WINDOWS)), "NEEDED": ", ".join(map(said, licences.NEEDED))}
    return Template(OP4).substitute(values, WORDS=licences.WORDS, NAMED=licences.NAMED, LEAST=licences.LEAST, N=len(passages))


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_line_chunks": OP2, "op4_licences": _op4(), "op9_substrings": OP9, "op11_ranked_search": OP11}
