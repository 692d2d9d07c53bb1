"""Column functions on numbers, dates, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .text import col

# First years of Japanese eras less one.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925}


def year(text: Column | str) -> Column:
    """A year in a text: of an era, else of four digits; null if there is none."""
    t, found = col(text), F.lit(None).cast("int")
    for era, before in reversed(ERAS.items()):
        n = F.regexp_extract(t, rf"{era}\s*(元|\d{{1,2}})", 1)
        found = F.when(n == "元", before + 1).when(n != "", n.try_cast("int") + before).otherwise(found)
    plain = F.nullif(F.regexp_extract(t, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")
    return F.coalesce(found, plain)


def japanese_number(text: Column | str) -> Column:
    """Numbers such as 7万2千 or 1,234.5; null without a digit."""
    t = F.translate(F.replace(col(text), F.lit(","), F.lit("")), "０１２３４５６７８９．", "0123456789.")
    pieces = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?[兆億万千百十]?)"), 1)
    scale = F.create_map(*(F.lit(x) for pair in {"兆": 1e12, "億": 1e8, "万": 1e4, "千": 1e3, "百": 1e2, "十": 10.0}.items() for x in pair))
    value = lambda p: F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * F.coalesce(F.try_element_at(scale, F.regexp_extract(p, r"\D$", 0)), F.lit(1.0))
    return F.when(F.size(pieces) > 0, F.aggregate(pieces, F.lit(0.0), lambda total, p: total + value(p)))


def feed_time(text: Column | str) -> Column:
    """A feed's date: RFC 822, then ISO 8601; without a zone it is UTC."""
    t = F.regexp_replace(F.trim(col(text)), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(col(text)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is missing or zero, or lengths differ."""
    x, y = (F.transform(col(v), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot(x, y) / norm).otherwise(0.0)


def unit(vector: Column | str) -> Column:
    v = F.transform(col(vector), lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, e: t + e * e))
    return F.transform(v, lambda e: e / F.when(norm == 0, 1.0).otherwise(norm))


def min_max(value: Column | str, by: list[str], flat: float) -> Column:
    """Scaled to 0..1 within a group; where all are equal, `flat`."""
    v, w = col(value), Window.partitionBy(*by)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high - low < 1e-12, flat).otherwise((v - low) / (high - low))


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Of two intervals: the overlap by the shorter one, 0 if disjoint or empty."""
    shared = F.least(high_a, high_b) - F.greatest(low_a, low_b)
    shorter = F.least(high_a - low_a, high_b - low_b)
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(0.0)


def recency(age: Column) -> Column:
    return F.greatest(100 * F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / 5.0), F.lit(5.0))


def time_fit(gap: Column) -> Column:
    return F.when(gap <= 2, 95.0).otherwise(F.greatest(95.0 - 10.0 * (gap - 2), F.lit(10.0)))


def geography_fit(found: Column, wanted: Column) -> Column:
    """Equal, containing or contained, unknown, different."""
    a, b = F.coalesce(found, F.lit("")), F.coalesce(wanted, F.lit(""))
    return F.when((a == "") | (b == ""), 55.0).when(a == b, 95.0).when(a.contains(b) | b.contains(a), 70.0).otherwise(25.0)


def lenient_score(text: Column | str, low: int, high: int, default: int) -> Column:
    """The first whole number of a text within bounds; 高, 中 and 低 are 7, 5 and 3."""
    t = F.translate(col(text), "０１２３４５６７８９", "0123456789")
    n = F.nullif(F.regexp_extract(t, r"-?\d+", 0), F.lit("")).try_cast("int")
    word = F.when(t.contains("高"), 7).when(t.contains("中"), 5).when(t.contains("低"), 3)
    found = F.coalesce(n, word)
    return F.when(found.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), found))).otherwise(default)


def display(value: Column | str) -> Column:
    """A number in 兆, 億 or 万 as it is read."""
    v = col(value)
    out = F.when(F.abs(v) < 1e4, F.format_number(v, 2))
    for scale, name in ((1e12, "兆"), (1e8, "億"), (1e4, "万")):
        out = out.when(F.abs(v) >= scale, F.concat(F.format_number(v / scale, 2), F.lit(name)))
    return out


def backoff(attempt: Column) -> Column:
    return F.least(2 * F.pow(F.lit(2.0), attempt), F.lit(60.0))


def hash_number(parts: list[Column], seed: int, modulus: int) -> Column:
    """A number below modulus that the parts and the seed fix."""
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % modulus
