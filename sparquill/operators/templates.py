"""Estimation models for questions from templates: candidates with formula, parameters, units and score, and what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from . import retrieval, units
from .extraction import period_unit

# Occupations behind the thing that they look after, and units of things, the first that fits.
OCCUPATION = "(.+?)(調律師|整備士|技術者|技師|保守要員|修理業者|点検員)"
OBJECTS = {"ピアノ": "piano", "車": "vehicle", "自動車": "vehicle", "EV": "vehicle", "傘": "umbrella", "ペットボトル": "bottle", "充電器": "charger"}
# How a score is made up, and the parts of each template's score but for its units.
WEIGHTS = {"estimability": 0.20, "explainability": 0.15, "evidence": 0.20, "double_counting": 0.10, "dependency": 0.05, "independence": 0.10, "units": 0.20}
SCORES = {
    "maintenance_demand": (0.85, 0.9, 0.8, 0.85, 0.7, 0.8),
    "association_supply": (0.7, 0.85, 0.6, 0.9, 0.85, 0.9),
    "population_ratio": (0.7, 0.85, 0.6, 0.8, 0.7, 0.6),
    "direct_lookup": (0.4, 0.6, 0.4, 0.95, 0.95, 0.7),
}
APPROACHES = {"maintenance_demand": "demand_side", "association_supply": "supply_side"}


def _score(template: str, fits: bool) -> float:
    return round(sum(w * s for w, s in zip(WEIGHTS.values(), (*SCORES[template], float(fits)), strict=True)), 3)


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _model(name: str, formula: str, wanted: Column, *parameters: tuple) -> Column:
    """struct of a template's formula, wanted unit and parameters (id, name, unit, power in the formula)."""
    rows = F.array(*(F.struct(F.lit(i).alias("id"), _text(n).alias("name"), _text(u).alias("unit"), F.lit(float(p)).alias("power")) for i, n, u, p in parameters))
    return F.struct(F.lit(name).alias("template"), F.lit(APPROACHES.get(name, name)).alias("approach"), F.lit(formula).alias("formula"), wanted.alias("wanted"), rows.alias("parameters"))


def _models(subject: Column, place: Column, period: Column, kind: Column, unit: Column) -> Column:
    """The templates that fit a question, as an array."""
    per = F.coalesce(F.nullif(period_unit(period), F.lit("")), F.lit("year"))
    flow, people = kind == "flow", unit == "person"
    thing, worker = F.trim(F.regexp_extract(subject, OCCUPATION, 1)), F.regexp_extract(subject, OCCUPATION, 2)
    piece = F.coalesce(*(F.when(F.contains(thing, F.lit(k)), u) for k, u in OBJECTS.items()), F.lit("item"))
    visit = F.when(worker == "調律師", "tuning").otherwise("event")
    staff = (worker != "") & people
    timed = F.when(flow, F.concat(unit, F.lit("/"), per)).otherwise(unit)
    demand = _model(
        "maintenance_demand",
        "base_households * ownership_rate * service_frequency / provider_capacity",
        unit,
        ("base_households", F.concat(place, F.lit("の世帯数")), "household", 1),
        ("ownership_rate", F.concat(thing, F.lit("保有率")), F.concat(piece, F.lit("/household")), 1),
        ("service_frequency", F.concat(thing, F.lit("1台あたり年間"), F.regexp_replace(worker, "[師士者員]+$", ""), F.lit("回数")), F.concat(visit, F.lit("/("), piece, F.lit("*year)")), 1),
        ("provider_capacity", F.concat(worker, F.lit("1人あたり年間対応件数")), F.concat(visit, F.lit("/(person*year)")), -1),
    )
    supply = _model(
        "association_supply",
        "association_members / membership_rate",
        unit,
        ("association_members", F.concat(worker, F.lit("団体の"), place, F.lit("会員数")), "person", 1),
        ("membership_rate", "組織率(団体加入率)", "dimensionless", -1),
    )
    everyone = ("population", F.concat(place, F.lit("の人口")), "person", 1), ("applicable_rate", F.concat(subject, F.lit("の該当率")), "dimensionless", 1)
    label = F.when(flow, F.when(per == "day", "(日次)").when(per == "month", "(月次)").otherwise("(年間)")).otherwise("")
    each = F.when(flow, F.concat(unit, F.lit("/(person*"), per, F.lit(")"))).otherwise(F.concat(unit, F.lit("/person")))
    heads = _model("population_ratio", "population * applicable_rate", timed, *everyone)
    amount = _model("population_ratio", "population * applicable_rate * quantity_per_person", timed, *everyone, ("quantity_per_person", F.concat(F.lit("該当者1人あたり数量"), label), each, 1))
    direct = _model("direct_lookup", "direct_value", timed, ("direct_value", F.concat(subject, F.lit("の公表値")), timed, 1))
    found = F.array(F.when(staff, demand), F.when(staff, supply), F.when(people & ~staff, heads).when(~people, amount), direct)
    return F.filter(found, lambda m: m.isNotNull())


def candidates(questions: DataFrame, key: str, subject: str = "subject", place: str = "place", period: str = "period", kind: str = "kind", unit: str = "unit") -> DataFrame:
    """(key, template, approach, formula, wanted, parameters, fits, score, rank) of questions, best first; `parameters` are (id, name, unit, power), and `fits`
    says whether their units make the wanted one, which is derived once for all questions with equal units. Questions without a subject have none; an empty unit counts events, an unknown place is the country."""
    named = lambda c, default: F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))
    asked = questions.where(F.trim(F.col(subject)) != "")
    found = _models(F.trim(F.col(subject)), named(place, "日本"), F.coalesce(F.col(period), F.lit("")), F.coalesce(F.col(kind), F.lit("stock")), named(unit, "event"))
    rows = asked.select(F.col(key).alias("key"), F.explode(found).alias("m")).select("key", "m.*")
    by = ["template", "_units", "wanted"]
    shaped = rows.withColumn("_units", F.transform("parameters", lambda p: F.struct(p["unit"].alias("unit"), p["power"].alias("power"))))
    made = F.aggregate("_units", units.none(), lambda total, p: units.times(total, units.raised(units.vector(p["unit"]), p["power"])))
    fits = F.coalesce(units.same(made, units.vector(F.col("wanted"))), F.lit(False)).alias("fits")
    fitted = shaped.join(shaped.select(*by).distinct().select(*by, fits), by).drop("_units")
    score = F.coalesce(*(F.when((F.col("template") == t) & (F.col("fits") == ok), _score(t, ok)) for t in SCORES for ok in (True, False)))
    return retrieval.top(fitted.withColumn("score", score), ["key"], [F.desc("score"), F.asc("template")], len(SCORES))


def answered(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds to candidates how many of their parameters are known by `known` (name, value: one row a name), and the model's value where all are; null where it
    divides by 0. What is known is joined by name, so it may be large."""
    parts = found.select("key", "template", F.explode("parameters").alias("p")).select("key", "template", "p.name", "p.power")
    given = parts.join(known.select("name", F.col("value").cast("double").alias("value")), "name", "left")
    factors = F.when(F.col("power") < 0, F.try_divide(F.lit(1.0), F.col("value"))).otherwise(F.col("value"))
    sums = given.groupBy("key", "template").agg(F.count("value").alias("known"), F.collect_list(factors).alias("_f"), F.count("*").alias("_n"))
    value = F.when(F.size("_f") == F.col("_n"), F.aggregate(F.array_sort("_f"), F.lit(1.0), lambda a, x: a * x))
    return found.join(sums.select("key", "template", "known", value.alias("value")), ["key", "template"])
