"""What a question in Japanese asks for: place, year, period, stock or flow, and unit, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of places, of which some mean the whole country.
PLACE = "(東京都|北海道|(?:京都|大阪)府|[一-龠ぁ-んァ-ン]{1,4}県|[一-龠ぁ-んァ-ン]{1,6}市(?![区町村場況街民])|日本国?内?|全国|世界)"
COUNTRY, WHOLE = "日本", ["国内", "日本国内", "全国"]
# A year, and what tells a flow and its period, the first that fits.
YEAR = "((?:19|20)[0-9]{2})年"
FLOWS = [("1日", r"毎日|日あたり|日当たり|[0-9０-９]+\s*日\s*(?:に|で|間|あたり|当たり)"), ("1年間", r"毎年|年あたり|年当たり|年間|[0-9０-９]+\s*年\s*(?:に|で|間)"), ("1か月", r"毎月|月あたり|月当たり|月間|[0-9０-９]*\s*か?月\s*(?:に|で|間)")]
STOCK = "何人いる|何台ある|何店ある|存在する|台数は|人数は|何人か|何人|何台|人数|台数"
# What tells the unit, its name in Japanese and the unit, the first that fits.
ASKED = [
    ("何人|人数|何名", "人", "person"), ("何世帯", "世帯", "household"), ("何台|台数", "台", "item"), ("何本", "本", "item"), ("何件|件数", "件", "event"),
    ("いくら|market|市場規模|金額|売上", "円", "JPY"), ("何店|店舗数", "店", "store"), ("何社", "社", "company"), ("何回", "回", "event"),
]


def _first(q: Column, options: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that fits, or null."""
    return F.coalesce(*(F.when(q.rlike(pattern), value) for value, pattern in options))


def asked(question: Column, place: Column | None = None, year: Column | None = None, unit: Column | None = None, this_year: int = 2026) -> Column:
    """struct(place, year, period, kind, unit, unit_name, assumed) of a question; `place`, `year` and `unit` (a name in Japanese), where not empty, hold.

    What a question doesn't tell is assumed, and named in the array `assumed`: the whole country, this year, a stock, counts. A null question tells nothing.
    """
    q = F.coalesce(question, F.lit(""))
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit("")) if c is not None else F.lit(None).cast("string")
    where = F.coalesce(given(place), F.nullif(F.regexp_extract(q, PLACE, 1), F.lit("")))
    when = F.coalesce(given(year), F.nullif(F.regexp_extract(q, YEAR, 1), F.lit("")))
    period, name = _first(q, FLOWS), given(unit)
    hinted = F.coalesce(*(F.when(name == n, u) for _, n, u in ASKED))
    told = _first(q, [(u, pattern) for pattern, _, u in ASKED])
    what = F.when(name.isNotNull(), hinted).otherwise(told)
    called = F.coalesce(name, _first(q, [(n, pattern) for pattern, n, _ in ASKED]), F.lit("件"))
    kind = F.when(period.isNotNull(), "flow").otherwise("stock")
    missing = [(where.isNull(), "place"), (when.isNull(), "year"), (period.isNull() & ~q.rlike(STOCK), "kind"), (what.isNull(), "unit")]
    assumed = F.filter(F.array(*(F.when(c, n) for c, n in missing)), lambda x: x.isNotNull())
    country = F.when(where.isNull() | where.isin(*WHOLE), COUNTRY).otherwise(where)
    return F.struct(country.alias("place"), F.coalesce(when, F.lit(str(this_year))).alias("year"), F.coalesce(period, F.lit("")).alias("period"), kind.alias("kind"), F.coalesce(what, F.lit("event")).alias("unit"), called.alias("unit_name"), assumed.alias("assumed"))
