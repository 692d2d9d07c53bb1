"""Fronts, nested JSON, units and formulas as rows against plain Python."""

import ast
import json
import random

from pyspark.sql import functions as F

from sparquill.functions import questions
from sparquill.operators import evidence, formula, nested, rewriting, simulation, units
from sparquill.sources import versions


def test_front_equals_all_pairs(spark):
    rng = random.Random(5)
    for axes, rows in ((1, 60), (2, 150), (3, 200), (4, 120), (12, 40)):
        pts = [(i, *(rng.choice([0.0, 1.0, 1.0 + 6e-10, 1.0 + 1.5e-9, 2.0, rng.random()]) for _ in range(axes))) for i in range(rows)]
        pts += [(1000 + i, *([i / 50, 1 - i / 50] + [0.5] * axes)[:axes]) for i in range(50)] + [(2000, *([None] * axes)), (2001, *([float("nan")] * axes))]
        names = [f"x{i}" for i in range(axes)]
        df = spark.createDataFrame(pts, "id int, " + ", ".join(f"{n} double" for n in names))
        live = [p for p in pts if p[0] < 2000]
        beats = lambda a, b: all(x >= y - 1e-9 for x, y in zip(a[1:], b[1:])) and any(x > y + 1e-9 for x, y in zip(a[1:], b[1:]))
        want = sorted(p[0] for p in live if not any(beats(o, p) for o in live))
        assert sorted(r.id for r in evidence.front(df, names, cells=64).collect()) == want
    assert evidence.front(df.where("id < 0"), names).count() == 0


def test_nested_values_equal_recursion(spark):
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            return rng.choice([None, 1, 2.5, "t", "", True, -3])
        if rng.random() < 0.4:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: tree(depth - 1) for k in rng.sample(["k", "a", "u", "in", "z"], rng.randint(0, 4))}

    def first(o, depth=0):
        if depth > 6 or not isinstance(o, dict | list):
            return None
        if isinstance(o, dict) and o.get("k") is not None:
            return o["k"]
        inner = [o[k] for k in sorted(o)] if isinstance(o, dict) else o
        return next((v for v in (first(x, depth + 1) for x in inner) if v is not None), None)

    def total(o, depth=0):
        if depth > 8 or not isinstance(o, dict | list):
            return []
        own = o.get("u") if isinstance(o, dict) else None
        number = own.get("in") if isinstance(own, dict) else None
        found = [number] if isinstance(number, int | float) and not isinstance(number, bool) else []
        return found + [v for x in ([v for k, v in o.items() if k != "u"] if isinstance(o, dict) else o) for v in total(x, depth + 1)]

    trees = [tree(11) for _ in range(150)]
    docs = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(900, None), (901, "{"), (902, "")]
    df = spark.createDataFrame(docs, "id int, j string")
    found = {r.id: r.value for r in nested.first_under(df, "id", "j", "k").collect()}
    want = {i: first(t) for i, t in enumerate(trees) if first(t) is not None}
    assert found.keys() == want.keys() and len(want) > 20
    assert all((found[i] if isinstance(v, str) else json.loads(found[i])) == v for i, v in want.items())
    sums = {r.id: r.n for r in nested.totals(df, "id", "j", "u", {"n": ("in",)}).collect()}
    assert len(sums) == len(docs) and all(sums[i] is None for i in (900, 901, 902))
    assert all((sums[i] is None) if not total(t) else abs(sums[i] - sum(total(t))) < 1e-9 for i, t in enumerate(trees))
    assert any(total(t) for t in trees)


def test_unit_vectors(spark):
    cases = {"": ("", 1.0), "1/year": ("time:-1", 1 / 365.25), "a": None, "person//day": None, "(person": None, "person/(day/hour)": ("person:1", 1 / 24), "km^-2": ("length:-2", 1e-6), "((day))": None, "*day": None, " 円 / 件 ": ("JPY:1,event:-1", 1.0)}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", units.vector(F.col("u")).alias("v"))
    for r in df.select("u", "v.factor", units.dimension_text(F.col("v")).alias("d")).collect():
        assert (r.factor is None) if cases[r.u] is None else (r.d == cases[r.u][0] and abs(r.factor / cases[r.u][1] - 1) < 1e-12), r
    assert spark.range(1).select(units.converted(F.lit(5), F.lit(None).cast("string"), F.lit("%")).alias("v")).first().v == 500.0


def _random_formula(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["a", "b", "c", "2", "1.5", "1000000"])
    kind = rng.choice(["+", "-", "*", "/", "**", "neg"])
    if kind == "neg":
        return f"-({_random_formula(rng, depth - 1)})"
    right = rng.choice("23") if kind == "**" else _random_formula(rng, depth - 1)
    return f"({_random_formula(rng, depth - 1)}){kind}({right})"


def test_formulas_come_back_and_units_agree(spark):
    """Written out and parsed again a tree is the same; vectors equal those of the recursion over one formula."""
    rng = random.Random(11)
    given = {i: _random_formula(rng, 4) for i in range(60)} | {900: "+".join("abc" * 12), 901: "import os", 902: None, 903: ""}
    said = {"a": "item/day", "b": "day", "c": "dimensionless"}
    models = spark.createDataFrame(list(given.items()), "model int, formula string")
    named = spark.createDataFrame([(i, n, u) for i in given for n, u in said.items()], "model int, name string, unit string")
    found = {r.model: r for r in rewriting.folded(rewriting.trees(models), named).withColumn("d", units.dimension_text(F.col("vector"))).collect()}
    assert found.keys() == given.keys() - {901, 902, 903}
    refused = 0
    for i, r in found.items():
        assert ast.dump(ast.parse(r.text, mode="eval")) == ast.dump(ast.parse(given[i], mode="eval"))
        try:
            dims, factor = formula.unit_of(given[i], said)
        except ValueError:
            refused += 1
            assert r.problem == "units of a sum differ"
        else:
            assert r.problem is None and abs(r.vector.factor / factor - 1) < 1e-9
            assert r.d == ",".join(f"{d}:{dims[d]}" for d in units.DIMENSIONS if d in dims)
    assert 0 < refused < len(found)


def test_rewrites(spark):
    models = spark.createDataFrame([(1, "a*b", "item"), (2, "a*b", "item"), (3, "a*a", "item"), (4, "x +", "item"), (5, "a - b", "item")], "model int, formula string, wanted string")
    parts = spark.createDataFrame([(1, "a", "c - d"), (2, "a", "b"), (3, "a", "e**2"), (5, "b", "c")], "model int, name string, formula string")
    named = spark.createDataFrame([(m, n, u) for m in range(1, 6) for n, u in (("a", "item/day"), ("b", "day"), ("c", "item/day"), ("d", "item/day"))], "model int, name string, unit string")
    found = {r.model: tuple(r)[1:] for r in rewriting.rewritten(models, parts, named).collect()}
    assert found == {1: ("(c - d) * b", True, None), 2: ("a * b", False, "other dimensions"), 3: ("a * a", False, "no unit of e"), 4: ("x +", False, "no formula"), 5: ("a - b", False, "other dimensions")}
    assert rewriting.rewritten(models.where("model < 0"), parts, named).count() == 0


def test_a_run_cut_between_two_writes_is_not_seen(spark, tmp_path):
    path, names = str(tmp_path / "store"), ["heads", "chunks", "vectors"]
    of = lambda ids, word, summary=None: {"heads": spark.createDataFrame([(i, summary) for i in ids], "id int, summary string"), "chunks": spark.createDataFrame([(i, f"{word}{k}") for i in ids for k in range(2)], "id int, text string"), "vectors": spark.createDataFrame([(i, [1.0]) for i in ids], "id int, v array<double>")}
    seen = lambda: sorted((r.id, r.text) for r in versions.read(spark, path, "chunks", "id").collect())
    versions.write(of([1, 2], "a", "kept"), path, "r1")
    assert seen() == [] and versions.publish(spark, path, "r1", names) == 1
    first = seen()
    assert first == [(1, "a0"), (1, "a1"), (2, "a0"), (2, "a1")]
    cut = of([2, 3], "b")
    cut["chunks"].write.parquet(f"{path}/chunks/run=r2")  # ends before vectors and heads are written
    assert seen() == first and versions.clean_up(spark, path, names, active=["r2"]) == []
    assert versions.clean_up(spark, path, names) == [("chunks", "r2", 4)] and versions.clean_up(spark, path, names) == []
    versions.write(cut, path, "r2")  # the run begins anew
    assert seen() == first and versions.publish(spark, path, "r2", names) == 2 and versions.publish(spark, path, "r2", names) == 2
    assert seen() == [(1, "a0"), (1, "a1"), (2, "b0"), (2, "b1"), (3, "b0"), (3, "b1")]
    heads = {r.id: r.summary for r in versions.read(spark, path, "heads", "id", keep=["summary"]).collect()}
    assert heads == {1: "kept", 2: "kept", 3: None}


def test_extremes_without_a_run_are_left_out(spark):
    m = spark.createDataFrame([(1, 1.0, 2.0, None, 1.0, 2.0, 4.0), (2, 1.0, 2.0, 3.0, 0.0, 2.0, 4.0)], "k int, a_low double, a_mid double, a_high double, b_low double, b_mid double, b_high double")
    found = {(r.k, r.kind): r.value for r in simulation.scenarios(m, "k", "a / b", ["a", "b"], custom={"b": F.lit(0.0)}).collect()}
    assert found == {(1, "extreme_low"): 0.25, (1, "extreme_high"): 2.0, (1, "custom"): None, (2, "custom"): None}


def test_questions(spark):
    ask = lambda q, **hints: spark.range(1).select(questions.asked(F.lit(q).cast("string"), **{k: F.lit(v) for k, v in hints.items()}).alias("a")).first().a
    assert tuple(ask(None)) == ("日本", "2026", "", "stock", "event", "件", ["place", "year", "kind", "unit"])
    assert tuple(ask("全国の車は何台ある", year="2020", unit="本")) == ("日本", "2020", "", "stock", "item", "本", [])
    assert ask("京都市場の件数は").place == "日本" and ask("2021年の人数").period == "" and ask("月間何回").period == "1か月" and ask("x", unit="tons").assumed[-1] == "unit"
