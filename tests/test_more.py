"""Operators whose results SQL doesn't hold, against brute force or hand-made cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparquill.functions import safety
from sparquill.functions.chunks import overlapping
from sparquill.operators import checks, clusters, evidence, extraction, graph, knowledge, packing, search, simulation, statistics
from sparquill.sources import readers, sinks
from tests.conftest import SF


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_pagerank_against_power_iteration(spark):
    edges = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 1), (4, 4), (5, 4), (1, 2)]
    found = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = sorted({n for e in edges for n in e})
    step = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        step[nodes.index(b), nodes.index(a)] += 1
    step /= step.sum(axis=0)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        rank = 0.85 * step @ rank + 0.15 / len(nodes)
    assert all(abs(found[n] - r) < 1e-6 for n, r in zip(nodes, rank))


def test_graph_scores(spark):
    node_keys = spark.createDataFrame([("n1", ["a", "b"]), ("n2", ["b"]), ("n3", ["c"]), ("n4", [])], "node string, keys array<string>")
    relations = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, weight double")
    found = {r.node: r.score for r in knowledge.graph_scores(node_keys.select("node"), node_keys, relations, seeds).collect()}
    assert found["n1"] == 1.0 and found["n4"] == 0.0 and found["n1"] > found["n2"] > found["n3"] > 0


def test_resolution_by_gradient(spark):
    e = np.eye(8)
    vectors = [e[0], e[0] + 0.01 * e[1], e[2], e[0] + 0.3 * e[3], e[2] + 0.9 * e[0], *(e[k % 8] + 0.2 * e[(k + 1) % 8] for k in range(30))]
    rows = [("b", k, v.tolist()) for k, v in enumerate(vectors)] + [("c", 0, e[0].tolist())]
    got = knowledge.resolve(spark.createDataFrame(rows, "book string, at int, v array<double>").repartition(3), "book", "at", "n", "v").collect()
    found = [r.entity for r in sorted(got, key=lambda r: (r.book, r["at"]))]
    own, want = [], []
    for v in vectors:
        mean = [np.mean(m, axis=0) for m in own]
        near = sorted(((float(m @ v / np.linalg.norm(m) / np.linalg.norm(v)), -k) for k, m in enumerate(mean)), reverse=True)[:10]
        n = next((i for i in range(1, len(near)) if not near[i][0] > 0.6 * near[i - 1][0]), len(near))
        if near and (near[0][0] >= 0.95 or n < len(near)):
            want.append(-near[0][1])
            own[want[-1]].append(v)
        else:
            want.append(len(own))
            own.append([v])
    assert found == [*want, 0]


def test_lexical_score_of_japanese_runs(spark):
    chunks = spark.createDataFrame([(1, "規程番号 REG-4711 の改訂"), (2, "XREG-47110Z"), (3, "改訂について"), (4, None), (5, "東京都庁舎案内の件")], "id int, text string")
    asked = spark.createDataFrame([(9, "REG-4711 規程"), (8, "東京都庁舎案内")], "q int, text string")
    found = {(r.question, r.id): (r.score, r.strong) for r in search.lexical(chunks, asked, "id", "text", "q", "text").collect()}
    assert found == {(9, 1): (3.0, True), (8, 5): (1.0, True)}
    part = spark.createDataFrame([(6, "東京タワー案内 庁舎")], "id int, text string")
    assert [(round(r.score, 3), r.strong) for r in search.lexical(part, asked.where("q = 8"), "id", "text", "q", "text").collect()] == [(0.5, False)]


ASKED = "parameter string, aliases array<string>, expected array<string>"


def test_numbers_near_an_alias(spark):
    def near(text, expected):
        asked = spark.createDataFrame([("p", ["世帯数", "growth"], expected)], ASKED)
        found = extraction.numbers_by_alias(spark.createDataFrame([(1, text)], "id int, text string"), asked, "id", "text").collect()
        return tuple(found[0])[2:7] if found else None

    assert near("世帯数は3件以上、7万2千世帯です。", ["household"]) == (72000.0, "household", 9, None, None)
    assert near("growth was 1.5 (range 1.0 - 2.0) in 2020", ["percent", ""])[4] == 2.0
    assert near("growth: 1.5〜2.0", [""]) == (1.5, "", 8, 1.5, 2.0)
    assert near("Xgrowths 5%", ["percent"]) is None and near("growth 5% 未満", ["person"]) is None and near(None, [""]) is None and near("5%", []) is None


def test_numbers_by_alias_equal_all_pairs(spark):
    """Random texts against every document and every parameter, in plain Python."""
    rng = random.Random(3)
    aliases = {"a": (["rate", "Total Rate"], ["percent", ""]), "b": (["件数", "数"], ["event"]), "c": (["GDP比"], ["percent"]), "d": (["%"], ["percent"]), "e": ([], ["day"]), "f": (["rate"], ["day"])}
    bits = ["rate", "total rate", "RATE", "件数", "数", "GDP比", " ", "。", "1.5", "12%", "3件", "7 days", "4千", "未満", "以上", "x" * 30, "é", "_", "\n", "2,000", "10 - 20%"]
    docs = [(i, "".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(120)] + [(900, None), (901, ""), (902, "rate " * 3000 + "5%" + "数 3件 " * 3000)]

    units = extraction.UNITS
    one = re.compile(rf"({extraction.RUN})\s*({extraction.WRITTEN})?", re.I)

    def want(text, names, expected):
        options = []
        numbers = [(m.start(), m[1], m[2], text[m.end() : m.end() + 2]) for m in one.finditer(text)]
        for name in names:
            if not re.search(r"[a-z0-9]|[^\x00-\x7f]", name, re.I):
                continue
            for p in re.finditer(rf"\b{name}\b" if name.isascii() else name, text, re.I if name.isascii() else 0):
                for at, run, written, after in numbers:
                    inside, far = p.start() <= at < p.end(), not p.start() - 40 <= at < p.end() + 120
                    unit = units[written.lower()] if written else ""
                    fits = unit in expected if unit else "" in expected and "." in run or not written and re.search("[兆億万千]", run)
                    if fits and not inside and not far and after[:1] not in ("以", "超") and after != "未満":
                        options.append((unit == "", abs(at - p.start()), at, unit))
        return min(options, default=None)

    asked = spark.createDataFrame([(k, *v) for k, v in aliases.items()], ASKED)
    found = extraction.numbers_by_alias(spark.createDataFrame(docs, "id int, text string"), asked, "id", "text").collect()
    got = {(r.id, r.parameter): (r.at, r.unit) for r in found}
    every = {(i, k): want(t or "", *v) for i, t in docs if i < 902 for k, v in aliases.items()}
    assert {k: v for k, v in got.items() if k[0] < 902} == {k: v[2:] for k, v in every.items() if v}
    assert len(got) == len(found) and (902, "a") in got and (902, "b") in got


def test_evidence_takes_tables_first(spark):
    schema = "id int, text string, header array<string>, rows array<array<string>>"
    docs = [(1, "piano count 9台", ["年", "piano count"], [["2020", "5台"]]), (2, "piano count 9台", ["年", "other"], [["2020", "5 days"]]), (3, None, None, None), (4, "調査方法: piano count 9台", None, None), (5, "x", [], [])]
    asked = spark.createDataFrame([("p", ["piano count"], ["item"])], ASKED)
    found = extraction.evidence(spark.createDataFrame(docs, schema), asked).collect()
    assert sorted((r.id, r.method, r.value, r.row, r["column"]) for r in found) == [(1, "table", 5.0, 1, 2), (2, "text", 9.0, None, None)]
    assert extraction.evidence(spark.createDataFrame([], schema), asked).count() == 0


def test_extraction_checks(spark):
    row = spark.range(1)
    v = lambda c: row.select(c.alias("v")).first().v
    assert v(extraction.supported(F.lit(0.104), F.lit("率は10.4%"))) and v(extraction.supported(F.lit(72000.0), F.lit("約7万2千人"))) and not v(extraction.supported(F.lit(5.0), F.lit("50")))
    assert v(extraction.refusal(F.lit(5.0), F.lit("有る 5 件"), F.lit("ここに有る5件"), F.lit(9.0), F.lit(None))) == "low not in the excerpt"
    assert v(extraction.period_unit(F.lit("1ヶ月あたり"))) == "month" and v(extraction.column_unit(F.lit("普及率(%)"))) == "percent"
    grid = spark.createDataFrame([(["年", "地域", "備考", "台数"], [["2019", "京都", "x", "1,200台"], ["2020", "東京", "y", "3万台"]], ["東京"])], "h array<string>, r array<array<string>>, a array<string>")
    found = extraction.grid_values(grid, F.col("h"), F.col("r"), F.col("a"), F.array(F.lit("item"))).first()
    assert (found.value, found.unit, found.row, found.column, found.period, found.place) == (30000.0, "item", 2, 4, "2020", "東京")
    assert extraction.grid_values(grid, F.col("h"), F.col("r"), F.col("a"), F.array(F.lit("person"))).count() == 0


def test_pages_for_display(spark):
    page = "<div onclick=x><p class=a>A &lt; b<script>alert(1)</script><iframe><p>no</p></iframe><b>c</b><br/><a href=javascript:1>d</a><!-- e --></div>"
    row = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r[0] for r in row.select(safety.displayable("h")).collect()] == ["<p>A &lt; b<b>c</b><br>d", ""]
    assert [r[0] for r in row.select(safety.tree_text("h")).collect()] == ["A < bc\nd", ""]


def test_chunks_of_long_sentences():
    text = "x" * 2500 + "\r\n\r\nSecond."
    found = overlapping(text, 1000, 100)
    assert found[0] == "x" * 1000 and all(len(c) <= 1101 for c in found) and found[-1].endswith("Second.") and "\r" not in "".join(found)
    assert sum(len(c.replace("\n", "").replace("Second.", "")) for c in found) > 2500  # parts share their ends
    assert overlapping("a\r\nb") == ["a\nb"]


@pytest.mark.parametrize("tail", [1.0, 1e12])
def test_quantiles_of_skewed_values(spark, tail):
    r = np.random.default_rng(3)
    values = [*np.exp(r.normal(size=400)).round(3).tolist(), tail, 0.5, 0.5, 0.5]
    rows = spark.createDataFrame([("g", k, float(v), float(1 + k % 5)) for k, v in enumerate(values)] + [("h", 0, 2.0, 1.0)], "g string, k int, v double, w double")
    found = {x.g: x for x in statistics.quantiles(rows, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).collect()}
    assert np.allclose([found["g"].a, found["g"].b, found["g"].c], np.quantile(values, [0.1, 0.5, 0.93])) and found["h"].b == 2.0
    order = sorted(range(len(values)), key=lambda k: (values[k], k))
    w = np.array([1 + k % 5 for k in order], float)
    centre = (np.cumsum(w) - w / 2) / w.sum()
    got = statistics.weighted_quantiles(rows.where("g = 'g'"), ["g"], "v", "w", {"a": 0.1, "b": 0.5, "c": 0.93}, ["k"]).first()
    assert np.allclose([got.a, got.b, got.c], np.interp([0.1, 0.5, 0.93], centre, [values[k] for k in order]))


def test_contradictions_and_skyline_against_all_pairs(spark):
    r = random.Random(5)
    rows = [(r.choice("xy"), k, round(10 ** r.uniform(-2, 3), 3)) for k in range(120)] + [("x", 900, 0.0), ("x", 901, 2.0), ("x", 902, 4.0)]
    found = {(x.p, x.a, x.b) for x in evidence.contradictions(spark.createDataFrame(rows, "p string, id int, v double"), "p", "id", "v").collect()}
    assert found == {(p, min(i, j), max(i, j)) for p, i, v in rows for q, j, w in rows if p == q and w > 0 and v > 2 * w}
    points = [(k, r.randrange(30), 30 - k % 17) for k in range(200)] + [(200 + k, k, 100 - k) for k in range(60)]
    front = {x.id for x in evidence.skyline(spark.createDataFrame(points, "id int, a int, b int"), "a", "b").collect()}
    assert front == {k for k, a, b in points if not any(c >= a and d >= b and (c, d) != (a, b) for _, c, d in points)}


def test_communities_part_clusters(spark):
    edges = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("p", "q")], "src string, dst string"))
    named = {r.node: r.community for r in graph.communities(edges).collect()}
    assert named["a"] == named["b"] == named["c"] != named["x"] == named["y"] == named["z"] and named["p"] == named["q"]


def test_claim_clusters_are_a_fold(spark):
    rows = sorted(run(spark, "claim_clusters").collect(), key=lambda r: (r.conv_id, r.turn))
    data = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    members: dict = {}
    for r in rows:
        own, text = members.setdefault(r.conv_id, []), data[r.conv_id, r.turn].text
        key = "system" if data[r.conv_id, r.turn].role == "system" else None
        place = next((n for n, (k, texts) in enumerate(own) if (key and k == key) or (not key and any(clusters.alike(text, t, 0.75) for t in texts))), None)
        if place is None:
            place = len(own)
            own.append((key, []))
        if not key:
            own[place][1].append(text)
        assert r.cluster == place


def test_context_groups_keep_their_bounds(spark):
    sizes = [3, 9, 2, 2, 2, 2, 2, 20, 1]
    rows = spark.createDataFrame([("d", k, s) for k, s in enumerate(sizes)], "d string, k int, s int")
    found = [r.group for r in packing.packed(rows, "d", "k", "s", 4, 10).orderBy("k").collect()]
    own = Counter(found)
    assert max(own.values()) <= 4 and found == sorted(found)
    assert all(own[g] == 1 or sum(s for s, x in zip(sizes, found) if x == g) <= 10 for g in own)


def test_simulation_and_copula(spark):
    got = {r.p_brand: r for r in run(spark, "simulate_brands").collect()}
    assert all(r.failed == 0 and r.p10 < r.p50 < r.p90 for r in got.values())
    again = {r.p_brand: r for r in run(spark, "simulate_brands").collect()}
    assert got == again
    draws = spark.range(4000).select(*(v.alias(k) for k, v in simulation.correlated(["a", "b"], np.array([[1.0, 0.8], [0.8, 1.0]]), 5, F.col("id").cast("string")).items())).toPandas()
    assert abs(draws.a.mean() - 0.5) < 0.02 and 0.75 < draws.rank().corr().iloc[0, 1] < 0.82


def test_files_of_a_collection(spark, tmp_path):
    for name in ("top.md", "a/x.MD", "a/b/y.txt", "a/b/z.exe"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r.name: r.tags for r in readers.collection_files(spark, str(tmp_path), ["md", "txt"]).collect()}
    assert found == {"top.md": [], "x.MD": ["a"], "y.txt": ["a", "b"]}
    for folder, name, body in (("i/one", "bookindex.json", '{"nodes": [1, 2, 3]}'), ("i/two", "docstore.json", '{"docs": [1]}'), ("i/two", "other.json", "{}")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    kinds = {r.folder.rsplit("/", 1)[1]: (r.kind, r.units) for r in readers.indexes(spark, str(tmp_path / "i")).collect()}
    assert kinds == {"one": ("book", 3), "two": ("paged", 1)}
    pages = spark.createDataFrame([("d", 2, "<table><tr><td>b</td></tr></table>"), ("d", 1, "<table><tr><td>a</td></tr></table>")], "doc string, page int, html string")
    assert [(t.page, t.rows) for t in readers.page_tables(pages, "doc", "page", "html").first().tables] == [(1, [["a"]]), (2, [["b"]])]


def test_moves_and_checks_on_nothing(spark):
    members = spark.createDataFrame([], "doc_id long, collection string, tags array<string>")
    assert all(df.count() == 0 for df in sinks.moved(members, "c", members)) and sinks.tag_union(members).count() == 0
    empty = spark.createDataFrame([], "user_id long, event_id long")
    assert checks.after_cursor(empty, "user_id", "event_id", spark.createDataFrame([], "user_id long, after long")).count() == 0
