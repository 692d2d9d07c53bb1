"""Chunks, JSON in texts, formulas, simulation, outlines and clusters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.functions import chunks, embedded
from sparquill.operators import clusters, formula, packing, simulation, trees
from sparquill.plans import queries


def test_overlapping_chunks():
    text = "First paragraph.\n\n" + "A sentence of some length. " * 30 + "\n\n" + "x" * 250
    found = chunks.overlapping(text, 100, 10)
    assert all(len(c) <= 111 for c in found) and found[1].startswith(found[0][-10:])
    assert chunks.overlapping("short") == ["short"] and chunks.overlapping(None) == [] and chunks.overlapping(" ") == []
    with pytest.raises(ValueError):
        chunks.overlapping("x", 10, 10)


def test_line_chunks_and_table(spark):
    assert chunks.lines("ab\ncd\n" + "x" * 12, 5) == ["ab\ncd", "xxxxx", "xxxxx", "xx"]
    found = chunks.chunked(spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id int, text string"), "id", "text", 3, None).collect()
    assert [(r.chunk, r.content) for r in found] == [("1#0", "a\nb")]


def test_json_in_texts():
    text = 'so ```json\n{"a": [1, 2,],}\n``` and then {"b": 3} {nope'
    assert embedded.first_value(text) == '{"a": [1, 2]}' and embedded.last_value(text) == '{"b": 3}'
    assert embedded.first_value("｛＂a＂：1｝") == '{"a": 1}' and embedded.first_value(None) is None and embedded.last_value("x") is None


def test_formula(spark):
    row = spark.createDataFrame([(6.0, 3.0, 0.0)], "a double, b double, z double")
    of = lambda t: row.select(formula.column(t, {n: F.col(n) for n in row.columns}).alias("y")).first().y
    assert of("-a / b + 2 ** 3") == 6 and of("a / z") is None
    for bad in ("a.b", "f(a)", "a ** 9", "a ** b", "[a]", "'x'", "a if b else z", "", "True + 1", "c"):
        with pytest.raises(ValueError):
            formula.column(bad, {"a": F.lit(1), "b": F.lit(1)})


def test_units():
    units = {"stock": "item", "rate": "event/(item*year)", "capacity": "event/(person*year)", "day_rate": "event/(item*day)"}
    assert formula.same_unit("stock * rate / capacity", units, "person")
    assert not formula.same_unit("stock * day_rate / capacity", units, "person")  # a year is not a day
    with pytest.raises(ValueError):
        formula.unit_of("stock + rate", units)


def test_draws(spark):
    df = spark.range(20_000).withColumn("u", simulation.uniform("x", 7, F.col("id")))
    draws = df.select(*(simulation.draw(k, F.col("u"), F.lit(10.0), F.lit(20.0), F.lit(40.0)).alias(k) for k in ("uniform", "loguniform", "lognormal", "triangular", "fixed")), simulation.normal(F.col("u")).alias("z"), "u").toPandas()
    for kind in ("uniform", "loguniform", "lognormal"):
        assert abs(np.quantile(draws[kind], 0.1) / 10 - 1) < 0.03 and abs(np.quantile(draws[kind], 0.9) / 40 - 1) < 0.03
    assert abs(draws.z.mean()) < 0.02 and abs(draws.z.std() - 1) < 0.02 and (draws.fixed == 20).all() and draws.triangular.between(2.5, 47.5).all()
    again = spark.range(20_000).repartition(7).select("id", simulation.uniform("x", 7, F.col("id")).alias("u")).orderBy("id").toPandas()
    assert (again.u.to_numpy() == draws.u.to_numpy()).all()


def test_correlated(spark):
    want = np.array([[1.0, 0.8], [0.8, 1.0]])
    u = simulation.correlated(["a", "b"], want, 3, F.col("id"))
    got = spark.range(20_000).select(simulation.normal(u["a"]).alias("a"), simulation.normal(u["b"]).alias("b")).toPandas()
    assert abs(np.corrcoef(got.a, got.b)[0, 1] - 0.8) < 0.02
    with pytest.raises(ValueError):
        simulation.correlated(["a", "b"], np.array([[1.0, 2.0], [2.0, 1.0]]), 3)


def test_simulation_and_sensitivity(spark):
    model = spark.createDataFrame([("m", 1.0, 2.0, 4.0, 10.0, 20.0, 40.0), ("z", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "k string, a_low double, a_mid double, a_high double, b_low double, b_mid double, b_high double")
    s = {r.k: r for r in simulation.summary(simulation.simulate(model, "k", "b / a", {"a": "fixed", "b": "uniform"}, 500, 1), "k").collect()}
    assert s["m"].n == 500 and s["m"].failed == 0 and abs(s["m"].p50 - 12.5) < 1 and s["z"].failed == 500
    t = {(r.k, r.name): r for r in simulation.sensitivity(model, "k", "a * b", ["a", "b"]).collect()}
    assert t["m", "a"].span == 60 and math.isclose(t["m", "a"].elasticity, 1) and t["z", "a"].elasticity is None


def test_outline(spark):
    rows = [(1, 1, 1, "A"), (1, 2, 0, "t"), (1, 3, 2, "B"), (1, 4, 3, "C"), (1, 5, 0, "u"), (1, 6, 2, "D"), (1, 7, 1, "E"), (2, 1, 0, "x")]
    tree = trees.outline(spark.createDataFrame(rows, "doc int, pos int, level int, title string"), "doc", "pos", "level")
    assert {(r.doc, r.pos): r.parent for r in tree.collect()} == {(1, 1): None, (1, 2): 1, (1, 3): 1, (1, 4): 3, (1, 5): 4, (1, 6): 1, (1, 7): None, (2, 1): None}
    assert {(r.doc, r.node): r.path for r in trees.heading_paths(tree, "doc", "pos", "title").collect()}[1, 5] == "A / B / C"
    below = trees.subtree(tree, "doc", "pos", spark.createDataFrame([(1, 3)], "doc int, root int"))
    assert {r.node for r in below.collect()} == {3, 4, 5}


def test_clusters(spark):
    rows = [(1, "h", None), (2, "h", "p"), (3, "i", "p"), (4, "j", ""), (5, "k", "")]
    found = {r.id: r.cluster for r in clusters.reprints(spark.createDataFrame(rows, "id long, hash string, primary string"), "id", ["hash", "primary"]).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    claims = [(1, 1, None, "the price is ten dollars"), (1, 2, "k", "x"), (1, 3, None, "the price was ten dollars"), (1, 4, "k", "completely other"), (1, 5, None, "rain"), (2, 1, None, "the price is ten dollars")]
    got = {(r.job, r.id): r.cluster for r in clusters.greedy_claims(spark.createDataFrame(claims, "job int, id int, key string, text string"), "job", "id", "key", "text", "id").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 1, (1, 5): 2, (2, 1): 0}


def test_claims_are_compared_whole(spark, tmp_path):
    from difflib import SequenceMatcher

    a, b, c = "rain fell on the hills all day\n" * 3, "prices of copper rose by a tenth\n" * 3, "nobody saw the ferry leave at noon\n" * 3
    turns = ["Hello\n" + a, "Hello\n" + b, "Good morning\n" + a, "Hello\n" + b + "now", None, "Hello", "Hello\n" + c, "Hello", ""]
    rows = [(k, n, "user", t) for k in (1, 2) for n, t in enumerate(turns[k - 1 :])] + [(1, 50 + k, "system", t) for k, t in enumerate((a, b))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want, open_ = {}, {}
    for conv, turn, role, text in rows:
        groups = open_.setdefault(conv, [])
        alike = lambda o: role == o[0] == "system" or "system" not in (role, o[0]) and text and o[1] and SequenceMatcher(None, text, o[1]).ratio() >= 0.75
        own = next((k for k, g in enumerate(groups) if any(map(alike, g))), len(groups))
        groups[own : own + 1] = [[*(groups[own] if own < len(groups) else []), (role, text)]]
        want[conv, turn] = own
    found = {(r.conv_id, r.turn): r.cluster for r in queries.QUERIES["claim_clusters"](spark, str(tmp_path)).collect()}
    assert found == want and found[1, 0] == found[1, 2] != found[1, 1] == found[1, 3]


def test_packing(spark):
    assert packing.groups([5, 5, 5, 20, 1, 1, 1], 2, 10) == [0, 0, 1, 2, 3, 3, 4] and packing.groups([], 2, 10) == []
    rows = spark.createDataFrame([(1, k, 4) for k in range(5)] + [(2, 0, None)], "d int, k int, n int")
    assert {(r.d, r.k): r.group for r in packing.packed(rows, "d", "k", "n", 6, 8).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (2, 0): 0}
