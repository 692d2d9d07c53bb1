"""Windows of license scans: none that can be a notice is left out, and long texts take time in proportion to their length."""

import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparquill.llm import licences, queries

PASSAGES = [body for bodies in licences.TEMPLATES.values() for body in bodies]
PROSE = "zebra source list software license version named 2.0 stone river found made house".split()


def texts(n, seed):
    """Passages with words left out, repeated, put in and wrapped, between lines of prose."""
    r, out = random.Random(seed), []
    for _ in range(n):
        lines = []
        for _ in range(r.randrange(1, 6)):
            words = [w for w in r.choice(PASSAGES).split() for _ in range(r.choice([0, 1, 1, 1, 1, 1, 2]))]
            words[len(words) // 2 : len(words) // 2] = r.choices(PROSE, k=r.randrange(6))
            width = r.choice([5, 9, 99])
            lines += [" ".join(words[i : i + width]) for i in range(0, len(words), width)] + [" ".join(r.choices(PROSE, k=r.randrange(9))) + ". And so on."] * r.randrange(2)
        out.append("\n".join(lines))
    return out


def cosine(body):
    tf = Counter(t for t in re.findall(licences.WORDS, body) if t not in licences.COMMON)
    v, passages = {t: n * licences.IDF.get(t, licences.UNKNOWN) for t, n in tf.items()}, {}
    for _, k, t, w in licences.WEIGHTS:
        passages[k] = passages.get(k, 0) + v.get(t, 0) * w
    return max(passages.values()) / np.sqrt(sum(x * x for x in v.values())) if v else 0


def test_no_window_of_the_least_cosine_is_left_out(table):
    data = texts(40, 3)
    docs = table(list(enumerate(data)), "doc_id long, text string")
    kept = {r.doc_id: {tuple(w) for w in r.w} for r in docs.select("doc_id", licences._windows(F.split(F.lower("text"), "\n")).alias("w")).collect()}
    n_near = n_all = 0
    for k, text in enumerate(data):
        lines = text.lower().split("\n")
        windows = {(i, 1, s) for i, line in enumerate(lines) for s in re.split(licences.SENTENCES, line)} | {(i, n, " ".join(lines[i : i + n])) for n in licences.WINDOWS for i in range(len(lines) - n + 1)}
        near = {w for w in windows if cosine(w[2]) >= licences.LEAST - 0.0001}
        assert near <= kept[k] <= windows
        n_near, n_all = n_near + len(near), n_all + len(windows)
    assert 100 < n_near < n_all


def test_prose_with_words_of_licences_has_no_windows_and_long_texts_take_no_square_of_time(table):
    prose = "\n".join(f"a license was named in row{k} of that thing{k % 97}, so they say" for k in range(4000))
    docs = table([(1, None, prose + "\nReleased under the MIT License.\n"), (2, None, "")], "doc_id long, path string, text string")
    kept = docs.select("doc_id", licences._windows(F.split(F.lower("text"), "\n")).alias("w")).where("doc_id = 1").first().w
    assert (4000, 1, "released under the mit license.") in {tuple(w) for w in kept} and len(kept) < 5
    began = time.time()
    found = {r.id: r.own_licence for r in licences.scan(docs, F.col("doc_id"), F.col("path"), F.col("text")).collect()}
    assert found == {1: "MIT", 2: None}
    assert time.time() - began < 90  # 49 s for half as many lines when each window cut its text anew


def test_odd_texts_equal_sql(spark, table, tmp_path):
    data = [*texts(60, 5), None, "", "\n\n", "software " * 40, "SPDX-LICENSE-IDENTIFIER: İSTANBUL MIT", "Licensed İ under CC BY 4.0.", *(p.upper() + " İSTANBUL" for p in PASSAGES[::9])]
    table([(k, t, "ab"[k % 2], None if k % 5 else "c/d") for k, t in enumerate(data)], "doc_id long, text string, lang string, source string", "documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op4_licences"])
    found = queries.op4_licences(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want.fetchall(), key=repr)


def test_a_directory_of_many_documents_is_not_summed_where_it_is_joined(table):
    docs = table([(k, "a/b/x", "Released under the MIT License.") for k in range(9)] + [(9, "a/b/y", "x")], "doc_id long, path string, text string")
    found = licences.scan(docs, F.col("doc_id"), F.col("path"), F.col("text"))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # beside an aggregate AQE doesn't split the join's partitions
    assert [r.licence for r in found.collect()] == ["MIT"] * 10
