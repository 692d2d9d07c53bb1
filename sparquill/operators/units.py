"""Units as vectors of powers: compound units are read, multiplied, compared and converted in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that stand for a dimension of their own, with their other names.
OWN = {
    "person": "person people capita worker customer tuner 人 名", "household": "household 世帯", "piano": "piano", "tuning": "tuning", "JPY": "JPY yen 円", "USD": "USD",
    "item": "item unit_item 台 本 個", "event": "event 件 回", "vehicle": "vehicle", "charger": "charger", "umbrella": "umbrella", "bottle": "bottle", "store": "store 店 店舗",
    "site": "site 拠点", "company": "company 社", "time": "day 日", "length": "meter m", "mass": "gram g",
}
# Units by dimension, power and factor.
MADE = {
    "year 年": ("time", 1, 365.25), "month 月": ("time", 1, 365.25 / 12), "week 週": ("time", 1, 7.0), "hour 時間": ("time", 1, 1 / 24), "minute 分": ("time", 1, 1 / 1440), "second 秒": ("time", 1, 1 / 86400),
    "man_yen 万円": ("JPY", 1, 1e4), "oku_yen 億円": ("JPY", 1, 1e8), "cho_yen 兆円": ("JPY", 1, 1e12), "kilometer km": ("length", 1, 1e3), "km2 km²": ("length", 2, 1e6),
    "kilogram kg": ("mass", 1, 1e3), "percent % パーセント": (None, 0, 0.01), "wari 割": (None, 0, 0.1), "dimensionless 無次元 1": (None, 0, 1.0),
}

#: Every unit by name: powers of its dimensions and its factor.
DEFINED = {name: ({dimension: 1}, 1.0) for dimension, names in OWN.items() for name in names.split()}
DEFINED |= {name: ({dimension: power} if power else {}, factor) for names, (dimension, power, factor) in MADE.items() for name in names.split()}
DIMENSIONS = list(OWN)


def made(factor: Column, powers: Column) -> Column:
    return F.struct(factor.cast("double").alias("factor"), powers.cast("array<double>").alias("powers"))


def none() -> Column:
    """The vector of a plain number."""
    return made(F.lit(1.0), F.array_repeat(F.lit(0.0), len(DIMENSIONS)))


def times(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of a product, or with sign -1 of a quotient."""
    factor = a["factor"] * b["factor"] if sign > 0 else F.try_divide(a["factor"], b["factor"])
    return made(factor, F.zip_with(a["powers"], b["powers"], lambda x, y: x + y * sign))


def raised(a: Column, n: Column) -> Column:
    return made(F.pow(a["factor"], n), F.transform(a["powers"], lambda x: x * n))


def comparable(a: Column, b: Column) -> Column:
    """Whether quantities of two vectors are of one kind."""
    return a["powers"] == b["powers"]


def same(a: Column, b: Column) -> Column:
    """Whether they can be compared without conversion."""
    return comparable(a, b) & (F.abs(F.try_divide(a["factor"], b["factor"]) - 1) <= 1e-6)


ATOM = r"[^*/()^]+"
FACTOR = rf"(?:\({ATOM}(?:\^-?[0-9]+)?(?:[*/]{ATOM}(?:\^-?[0-9]+)?)*\)|{ATOM})(?:\^-?[0-9]+)?"
PART = rf"([*/]?)(\([^()]*\)|{ATOM})(\^-?[0-9]+)?"


def vector(unit: Column) -> Column:
    """struct(factor, powers by DIMENSIONS) of a unit such as event/(item*year) or km**2, or null where it isn't one. An empty or null unit is a plain number;
    parentheses don't nest."""
    u = F.replace(F.replace(F.regexp_replace(F.coalesce(unit, F.lit("")), r"\s+", ""), F.lit("**"), F.lit("^")), F.lit("·"), F.lit("*"))
    powers = lambda d: F.array(*(F.lit(float(d.get(x, 0))) for x in DIMENSIONS))
    known = F.create_map(*(x for name, (d, f) in DEFINED.items() for x in (F.lit(name), made(F.lit(f), powers(d)))))

    def parts(text: Column) -> Column:
        every = [F.regexp_extract_all(text, F.lit(PART), k) for k in (1, 2, 3)]
        power = lambda p: F.when(p["2"] == "", 1.0).otherwise(F.substring(p["2"], 2, 9).cast("double")) * F.when(p["0"] == "/", -1.0).otherwise(1.0)
        return F.transform(F.arrays_zip(*(e.alias(str(k)) for k, e in enumerate(every))), lambda p: F.struct(p["1"].alias("name"), power(p).alias("n")))

    inner = lambda p: F.transform(parts(F.regexp_replace(p["name"], r"[()]", "")), lambda q: F.struct(F.try_element_at(known, q["name"]).alias("v"), (p["n"] * q["n"]).alias("n")))
    found = F.flatten(F.transform(parts(u), inner))
    whole = F.aggregate(found, none(), lambda total, p: times(total, raised(p["v"], p["n"])))
    fine = u.rlike(rf"^{FACTOR}(?:[*/]{FACTOR})*$") & ~F.exists(found, lambda p: p["v"].isNull())
    return F.when(u == "", none()).when(fine, whole)


def converted(value: Column, unit: Column, wanted: Column) -> Column:
    """The value in another unit, or null where a unit is unknown or the two aren't of one kind."""
    a, b = vector(unit), vector(wanted)
    return F.when(comparable(a, b), value.cast("double") * a["factor"] / b["factor"])


def dimension_text(v: Column) -> Column:
    """The powers that aren't 0 as text, such as item:1,time:-1."""
    named = F.zip_with(F.array(*map(F.lit, DIMENSIONS)), v["powers"], lambda d, p: F.when(p != 0, F.concat(d, F.lit(":"), p.cast("int").cast("string"))))
    return F.when(v.isNotNull(), F.array_join(F.filter(named, lambda x: x.isNotNull()), ","))
