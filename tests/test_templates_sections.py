"""Model templates and blocks selected by section, on small rows."""

from pyspark.sql import functions as F

from sparquill.functions import questions
from sparquill.operators import knowledge, templates, trees
from sparquill.sources import readers, sinks

ASKED = "key long, subject string, place string, period string, kind string, unit string"


def test_templates_of_questions(spark):
    rows = [(1, "ピアノ調律師", "東京都", "", "stock", "person"), (2, "傘", None, "1か月", "flow", ""), (3, " ", "日本", "", "stock", "item"), (4, None, None, None, None, None), (5, "エレベーター保守要員", "", None, None, "item")]
    found = templates.candidates(spark.createDataFrame(rows, ASKED), "key")
    got = {(r.key, r.template): r for r in found.collect()}
    assert set(got) == {(1, "maintenance_demand"), (1, "association_supply"), (1, "direct_lookup"), (2, "population_ratio"), (2, "direct_lookup"), (5, "population_ratio"), (5, "direct_lookup")}
    assert all(r.fits for r in got.values())
    first = got[1, "maintenance_demand"]
    assert (first.rank, first.score) == (1, 0.865)
    assert [p.name for p in first.parameters] == ["東京都の世帯数", "ピアノ保有率", "ピアノ1台あたり年間調律回数", "調律師1人あたり年間対応件数"]
    assert got[2, "direct_lookup"].wanted == "event/month"
    assert [(p.name, p.unit) for p in got[2, "population_ratio"].parameters][::2] == [("日本の人口", "person"), ("該当者1人あたり数量(月次)", "event/(person*month)")]


def test_values_of_what_is_known(spark):
    rows = [(1, "ピアノ調律師", "東京都", "", "stock", "person"), (1, "ピアノ調律師", "東京都", "", "stock", "person"), (2, "整備士", "日本", "", "stock", "person")]
    found = templates.candidates(spark.createDataFrame(rows[1:], ASKED), "key")
    known = [("東京都の世帯数", 7e6), ("ピアノ保有率", 0.2), ("ピアノ1台あたり年間調律回数", 0.5), ("調律師1人あたり年間対応件数", 700.0), ("組織率(団体加入率)", 0.0), ("調律師団体の東京都会員数", 5.0), ("整備士の該当率", None)]
    got = {(r.key, r.template): (r.known, r.value) for r in templates.answered(found, spark.createDataFrame(known, "name string, value double")).collect()}
    assert got[1, "maintenance_demand"][0] == 4 and abs(got[1, "maintenance_demand"][1] - 1000) < 1e-6
    assert got[1, "association_supply"] == (2, None)  # divided by 0
    assert got[2, "population_ratio"] == (0, None)  # an occupation without a thing before it is no occupation
    assert templates.answered(found.limit(0), spark.createDataFrame(known, "name string, value double")).count() == 0


def test_templates_of_parsed_questions(spark):
    asked = spark.createDataFrame([(1, "2020年の東京都にピアノ調律師は何人いる?", "ピアノ調律師"), (2, "1日に捨てられる傘は何本か", "傘")], "key long, question string, subject string")
    parsed = asked.withColumn("a", questions.asked(F.col("question"))).select("key", "subject", "a.*")
    got = sorted((r.key, r.template, r.wanted) for r in templates.candidates(parsed, "key").collect() if r["rank"] == 1)
    assert got == [(1, "maintenance_demand", "person"), (2, "population_ratio", "item/day")]


def _selected(spark, levels, vectors, chosen):
    """Of documents' levels (0 is text) and vectors of headings, with one question to each document."""
    blocks = spark.createDataFrame([(d, i, x) for d, ls in levels.items() for i, x in enumerate(ls)], "doc long, node long, level int")
    tree = trees.outline(blocks, "doc", "node", "level")
    titles = spark.createDataFrame([(d, i, v) for (d, i), v in vectors.items()], "doc long, node long, vector array<double>")
    asked = spark.createDataFrame([(10 * d, d, [1.0, 0.0]) for d in levels], "question long, doc long, vector array<double>")
    picked = spark.createDataFrame(chosen, "question long, node long") if chosen is not None else None
    found = knowledge.selected_by_section(asked, titles, tree, "doc", "node", F.col("level") > 0, picked, 1)
    return sorted((r.question, r.node) for r in found.collect())


def test_sections_that_are_chosen_or_nearest(spark):
    levels = {1: [1, 0, 2, 0, 1, 0], 2: [0, 0], 3: [1, 2]}
    vectors = {(1, 0): [0.0, 1.0], (1, 2): None, (1, 4): [1.0, 0.1], (3, 0): [1.0, 0.0], (3, 1): [1.0, 0.0]}
    flat = [(20, 0), (20, 1)]
    assert _selected(spark, levels, vectors, None) == [(10, 5), *flat, (30, 0), (30, 1)]
    assert _selected(spark, levels, vectors, [(10, 0), (10, 0), (10, 1), (10, 99), (20, 0), (30, 1)]) == [(10, 1), (10, 3), *flat, (30, 1)]
    assert _selected(spark, levels, vectors, [(10, 3)]) == [(10, 5), *flat, (30, 0), (30, 1)]


def test_graph_files_each_under_their_own_keys(spark, tmp_path):
    file = '<graphml><key id="a" attr.name="{}"/><key id="a" attr.name="again"/><key id="b" attr.name="weight"/><graph><node id="x"><data key="a">{}</data><data key="a">no</data></node><node id="y"/><edge source="x" target="y"><data key="b">{}</data></edge></graph></graphml>'
    for i, words in enumerate([("description", "one", "11"), ("type", "two", "heavy")]):
        (tmp_path / f"{i}.graphml").write_text(file.format(*words))
    nodes, edges = readers.graphml(spark, str(tmp_path))
    found = sorted((r.id, r.type, r.description) for r in nodes.collect())
    assert [f for f in found if f[0] == "y"] == [("y", "", "")] * 2 and len(found) == 4
    assert sorted(r.strength for r in edges.collect()) == [5, 10]


def test_feeds_switched(spark):
    feeds = spark.createDataFrame([("a", True), ("b", False), ("c", None), (None, True), ("d", True)], "id string, enabled boolean")
    after, change = sinks.set_enabled(feeds, "id", ["a", "b", "c", "z"], False)
    assert {r.id: r.enabled for r in after.collect()} == {"a": False, "b": False, "c": False, None: True, "d": True}
    assert sorted(r.id for r in feeds.where(change).collect()) == ["a", "c"]
    assert sinks.set_enabled(feeds.limit(0), "id", [], True)[0].count() == 0
