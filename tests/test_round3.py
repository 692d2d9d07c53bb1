"""Queries against their SQL on rows that the given tables hardly have."""

import os
import random
import re
import tracemalloc
from datetime import timedelta

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparquill.functions import text
from sparquill.operators import checks, extraction, graph, knowledge, nested, packing, retrieval, rewriting, search, trees
from sparquill.plans import reader_queries, record_queries
from sparquill.sources import readers
from sparquill.streaming import breakers
from tests.conftest import SF
from tests.test_timers import START, _folded

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def sorted_rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


def compared(spark, folder, name):
    """The rows of a query and of its SQL over a folder of tables; tables that it lacks are those of the smallest size."""
    own = {f.removesuffix(".parquet"): f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "") for f in os.listdir(folder)}
    con = duckdb.connect()
    for f in os.listdir(SF):
        stem = f.removesuffix(".parquet")
        if stem not in own:
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
            own[stem] = f"{SF}/{f}"
    for stem, path in own.items():
        con.sql(f"CREATE VIEW {stem} AS SELECT * FROM read_parquet('{path}')")
    return sorted_rows(QUERIES[name](spark, str(folder)).toPandas()), sorted_rows(con.sql(SQL[name]).df())


OPEN_ENDED = ["<p>a &amp</p><p>b&copy c &middot&quot;d", "<p>x &amp&copy; y&am</p>", "<style>a{}<script></style> z &ampcopy; &amp;quot", "a <p", "", None]


@pytest.mark.parametrize("name", ["html_strip", "tree_text"])
def test_references_without_semicolon(spark, table, tmp_path, name):
    table([(k, "u", h) for k, h in enumerate(OPEN_ENDED)], "page_id long, url string, html string", "pages")
    found, want = compared(spark, tmp_path, name)
    assert found == want and len(found) == len(OPEN_ENDED)


def test_breakers_of_one_key_over_many_ranges(spark):
    """A key's results lie in several tasks; runs and openings go over their borders, and no window looks ahead row by row."""
    rng = random.Random(7)
    now, calls = 0.0, []
    for k in range(700):
        now += rng.choice([1, 30, 30, 150])
        calls.append((k % 7 // 6, k, START + timedelta(seconds=now), rng.random() < (1.0 if 200 < k < 400 else 0.8)))
    want = _folded(calls, 3, 100, 100)
    zero = spark.sql("SELECT unix_millis(timestamp'2024-01-01')").first()[0]
    rng.shuffle(calls)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = breakers.openings_in(spark.createDataFrame(calls, "key long, id long, time timestamp, failed boolean"), 3, 100, 100)
        got = sorted(tuple(r) for r in found.collect())
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    ms = lambda t: zero + round((t - START).total_seconds() * 1000)
    assert got == [(k, ms(a), ms(b), n) for k, a, b, n in want] and len(want) > 20


def test_rewriting_broadcasts_nothing_that_grows(spark, table):
    """Names of all models once passed for a small table, as the file that they are unfolded from is small."""
    models = table([(k, "a*b", "person") for k in range(50)], "model long, formula string, wanted string", "models")
    unfolded = models.select("model", F.explode(F.create_map(F.lit("a"), F.lit("person"), F.lit("b"), F.lit("dimensionless"), F.lit("c"), F.lit(None).cast("string"))).alias("name", "unit"))
    parts = models.select("model", F.lit("b").alias("name"), F.when(F.col("model") % 2 == 0, "b/2").otherwise("c").alias("formula"))
    found = rewriting.rewritten(models.select("model", "formula", "wanted"), parts, unfolded)
    assert {(r.formula, r.accepted, r.reason) for r in found.collect()} == {("a * (b / 2)", False, "other scale"), ("a * b", False, "no unit of c")} or found.where("accepted").count() == 25
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    leaves = rewriting.folded(rewriting.trees(models.select("model", "formula")), unfolded)
    assert leaves.where("problem IS NULL AND text = 'a * b'").count() == 50


def _most_tasks(spark, group, call):
    """What a call returns, and the tasks of the largest stage of its jobs."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        found, tracker = call(), spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return found, [s.numTasks for s in stages if s]
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)


def test_all_cores_write_and_few_tasks_list_files(spark, table, tmp_path):
    """A file for each supplier; files are listed in a few tasks for each core, not in one each."""
    table([(k, f"S{k}", k % 2, k + 0.5) for k in range(90)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double", "supplier")
    path, tasks = _most_tasks(spark, "write", lambda: reader_queries._files(spark, str(tmp_path)))
    assert max(tasks) >= spark.sparkContext.defaultParallelism
    found, tasks = _most_tasks(spark, "list", lambda: readers.markdown_files(spark, f"{path}/*/*.txt"))
    assert sorted(r.title for r in found.collect()) == sorted(f"S{k}" for k in range(90))
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for k in range(90):
        (tmp_path / f"a/b{k}").mkdir(parents=True)
        (tmp_path / f"a/b{k}/n.md").write_text("x")
    found, tasks = _most_tasks(spark, "folders", lambda: readers.collection_files(spark, str(tmp_path), ["md"]))
    assert {tuple(r.tags) for r in found.collect()} == {("a", f"b{k}") for k in range(90)}
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def _most_joined(found):
    """The rows of a frame, and the largest number of rows that one of its joins gave."""
    rows = found.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
        children = [inner] if inner is not None else [plan.children().apply(k) for k in range(plan.children().size())]
        own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in kind else []
        return own + [n for child in children for n in walk(child)]

    return rows, max(walk(found._jdf.queryExecution().executedPlan()))


def test_models_meet_a_cluster_once(spark, table):
    """Uses of one cluster were joined with each other: 400 by 400."""
    uses = table([(m, f"{m if k % 2 else 'x'}{k}", "c", "D" if k % 4 == 0 else None) for m in "ab" for k in range(400)] * 2, "model string, item string, cluster string, cls string")
    rows, most = _most_joined(checks.shared_evidence(uses, "model", "item", "cluster", "cls", ["D"]))
    assert [(r.a, r.b, r["items"], r.clusters, r.weak) for r in rows] == [("a", "b", 200, 1, 100)]
    assert most <= 400


def test_weak_relations_meet_no_question(spark, table):
    """All relations of an entity met all questions that name it; a loop, a relation of two named entities and a repeated one count once."""
    relations = [(1, k, float(k % 50)) for k in range(1, 200)] + [(2, 1, 49.0), (2, 1, 49.0), (3, 9, 1.0)]
    asked = [(q, e) for q in range(60) for e in (1, 2)] + [(99, 3), (100, 777)]
    rows, most = _most_joined(knowledge.relation_hits(table(asked, "question long, key long", "asked"), table(relations, "source long, target long, strength double", "r"), 5))
    best = lambda keys: sorted({r for r in relations if r[0] in keys or r[1] in keys}, key=lambda r: (-r[2], r[0], r[1]))[:5]
    want = {(q, *r, k) for q in [*range(60), 99] for k, r in enumerate(best((1, 2) if q < 60 else (3,)), 1)}
    assert {(r.question, r.source, r.target, r.strength, r.rank) for r in rows} == want and len(rows) == len(want)
    assert most <= 60 * 2 * 5 + 2 * 5


def test_landed_files_grow_in_number_with_the_table(spark):
    """A table of any size was dealt to four files, so a task read a quarter of it."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        parts = docs.rdd.getNumPartitions()
        assert record_queries._landed(docs).rdd.getNumPartitions() == parts > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lexical_terms_stay_where_texts_are(spark, monkeypatch):
    """No term of a text is shuffled, and with k the best stay; blocks and portions are small here. Against brute force, runs of bigrams included."""
    monkeypatch.setattr(search, "ASKED", 12)
    monkeypatch.setattr(search, "CELLS", 60)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["ab", "cd-1", "x9", "7", "".join(rng.choice("東京都庁") for _ in range(rng.randint(1, 9)))]) for _ in range(n))
    docs, asked = [(k, text(4)) for k in range(80)] + [(80, None)], [(k, text(3)) for k in range(9)] + [(3, "x9 ab"), (9, ""), (10, None)]
    runs = lambda t: re.findall("[東京都庁]+", t or "")
    grams = lambda r: [r[i : i + 2] for i in range(max(len(r) - 1, 1))]
    exact = lambda t: list(dict.fromkeys(w for w in (t or "").split() if w in ("ab", "cd-1", "x9")))
    want = {}
    for q in {q for q, _ in asked}:
        own = [t for k, t in asked if k == q]
        words, rows = [w for t in own for w in exact(t)], [[grams(r) for r in runs(t)] for t in own]
        for d, t in docs:
            has = {g for r in runs(t) for g in grams(r)}
            n, every = sum(w in exact(t) for w in words), {g for row in rows for r in row for g in r}
            most = max((len(part) for row in rows for r in row for part in "".join("x" if g in has else " " for g in r).split()), default=0)
            if n or every & has:
                share = len(every & has) / max(len(every), 1)
                want[q, d] = 2.0 * n + share, bool(n or share >= 0.75 or most >= 4)
    left, right = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(asked, "q long, t string")
    found = search.lexical(left, right, "id", "t", "q", "t")
    assert "hashpartitioning(term" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.question, r.id): (r.score, r.strong) for r in found.collect()} == want and found.count() == len(want)
    best = search.lexical(left, right, "id", "t", "q", "t", 2)
    first = lambda rows: {(q, tuple(sorted((-s, d) for a, d, s in rows if a == q)[:2])) for q, _, _ in rows}
    assert first([(r.question, r.id, r.score) for r in best.collect()]) == first([(q, d, s) for (q, d), (s, _) in want.items()])
    assert best.count() < len(want)


def test_vectors_meet_in_small_portions(spark, monkeypatch):
    """Rows meet questions a few at a time, and those that can't be among the best any more aren't sorted; ties by id, against brute force."""
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROWS", 4)
    rng = random.Random(5)
    rows = [(k, [float(rng.randint(-1, 1)) for _ in range(3)]) for k in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    size = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    near = lambda v, w: round(sum(x / size(v) * (y / size(w)) for x, y in zip(v, w, strict=True)), 6) + 0.0
    want = {(q, r, d) for q, v in rows if q % 7 == 0 for r, (_, d) in enumerate(sorted((-near(v, w), d) for d, w in rows if d != q)[:5], 1)}
    assert {(r.question, r["rank"], r.id) for r in retrieval.vector_top(df, df.where("vec_id % 7 = 0"), 5).collect()} == want


def test_keyword_heads_in_small_portions(spark, monkeypatch):
    """Heads of a few texts at a time are held, and one text's are the same wherever it stands."""
    monkeypatch.setattr(search, "CHARS", 7)
    texts = pa.array(["", "abcdef", "ab", "ß東京x" * 3, "a", "abcdefghijkl"])
    found = list(search._heads([pa.record_batch([pa.array(range(6), pa.int64()), texts], ["_row", "_text"])]))
    got = sorted((r["_row"], r["_head"]) for part in found for r in part.to_pylist())
    assert got == sorted((k, h) for k, t in enumerate(texts.to_pylist()) for h in {t[i : i + n] for n in range(4) for i in range(len(t) - n + 1)})
    assert len(found) > 2 and max(len(set(part["_row"].to_pylist())) for part in found) < 6


def test_groups_of_a_document_over_many_batches(spark):
    """No document is a group of its own in Python; one that goes over batches is packed as one, and a null size counts 0."""
    rng = random.Random(9)
    rows = [(d, k, rng.choice([None, 1, 3, 9])) for d, n in ((1, 23), (2, 1), (3, 40), (None, 5)) for k in range(n)]
    want = {(d, k): g for e in (1, 2, 3, None) for (d, k, _), g in zip([r for r in rows if r[0] == e], packing.groups([r[2] or 0 for r in rows if r[0] == e], 4, 10), strict=True)}
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = packing.packed(spark.createDataFrame(rows, "d long, k long, s long"), "d", "k", "s", 4, 10)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.d, r.k): r.group for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pagerank_reads_edges_once_and_deals_nodes_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "NODES", 2)
    monkeypatch.setattr(graph, "LINKS", 1)
    links = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5), (6, 1)]
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    edges = spark.createDataFrame(links, "src long, dst long").withColumn("src", F.udf(seen, "long")("src"))
    found = {r.node: r["rank"] for r in graph.pagerank(edges, rounds=3).collect()}
    assert read.value == len(links)
    rank = {k: 1 / 6 for k in range(1, 7)}
    for _ in range(3):
        new = {k: 0.15 / 6 + 0.85 * rank[5] / 6 for k in rank}
        for a, b in links:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in links)
        rank = new
    assert found.keys() == rank.keys() and all(abs(found[k] - rank[k]) < 1e-12 for k in rank)


def test_nested_values_come_from_one_walk(spark):
    """Levels were derived anew for every deeper one: one parse for each. Nulls, scalars, other keys and what isn't JSON have no value."""
    texts = ['{"a": [1, {"k": null, "b": {"k": 3}}], "k\'s": 1}', '[[{"k": {"x": 1}}], {"k": 2}]', '"k"', "{", None, '{"b": [{"k": "t"}], "a": {"k": null}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    found = nested.first_under(rows, "id", "j", "k")
    assert {r.id: r.value for r in found.collect()} == {0: "3", 1: '{"x":1}', 5: "t"}
    assert {r.id: r.value for r in nested.first_under(rows, "id", "j", "k", 1).collect()} == {1: "2"}
    assert {r.id: r.value for r in nested.first_under(rows, "id", "j", "k's").collect()} == {0: "1"}
    assert sorted((r.id, tuple(r.path)) for r in nested.nodes(rows, "id", "j", 2).select("id", "path").collect()) == [(0, ()), (0, (0,)), (0, (0, 1)), (1, ()), (1, (0,)), (1, (0, 0)), (1, (1,)), (2, ()), (5, ()), (5, (0,)), (5, (1,)), (5, (1, 0))]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_numbered_sources_are_read_once(spark):
    """The sources of a report were read from its text again for each of them."""
    report = "## Sources\n[1] A: https://a.b/1\n[2] B: https://a.b/2\n[3] A again: https://a.b/1\n[4] C https://a.b/3)"
    rows = spark.createDataFrame([(report,), (None,), ("none",)], "t string").select(text.numbered_sources("t").alias("s"))
    assert [[tuple(x) for x in r.s] for r in rows.collect()] == [[(1, "A", "https://a.b/1"), (2, "B", "https://a.b/2"), (4, "C", "https://a.b/3")], [], []]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_numbers_of_a_batch_are_not_all_held_as_objects():
    texts = pa.array([f"{k} units, " * 20 for k in range(4000)] + [None, ""])
    tracemalloc.start()
    found = extraction.number_offsets.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and all(len(row) == 20 for row in found[:4000]) and not len(found[4000]) and not len(found[4001])
    assert found[7][1].as_py() == {"at": 9, "run": "7", "written": None, "next": "un", "tail": texts[7].as_py()[9 : 9 + extraction.TAIL]}
    assert peak < 10e6
    places = extraction.alias_offsets.func(pa.array(["a b A"] * 300 + [None]), pa.array([["a", "B"]] * 300 + [None], pa.list_(pa.string())))
    assert places[299].as_py() == [{"alias": "a", "at": 0}, {"alias": "a", "at": 4}, {"alias": "B", "at": 2}] and places[300].as_py() == []


def test_ancestors_join_each_step_once(spark):
    rows = [(1, k, k, k - 1 if k else None) for k in range(7)] + [(2, 0, 1, None), (2, 1, 0, 0)]
    tree = spark.createDataFrame(rows, "d int, n int, level int, parent int")
    found = trees.ancestors(tree, "d", "n")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted([(1, a, b, a - b) for a in range(7) for b in range(a)] + [(2, 1, 0, 1)])
