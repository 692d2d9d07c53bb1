"""Column functions on texts, HTML and URLs. All but `decode_entities`, `nfkc` and what builds on them stay in the JVM."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ranges of Chinese and Japanese characters whose runs are cut into bigrams.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]+"
# Beginnings of the names of query parameters that only track.
TRACKING = r"^(utm_|fbclid|gclid|ref_|mc_eid|mc_cid)"
# What is redacted, and what stands for it.
SECRETS = [
    (r"(?i)(authorization\s*[:=]\s*)(bearer|basic)?\s*[A-Za-z0-9+/_\-.=]{8,}", "$1[REDACTED]"),
    (r"(?i)((?:api[-_]?key|x-api-key|apikey|token|secret)\s*[:=]\s*)[^\s&\"']{8,}", "$1[REDACTED]"),
    (r"(?i)(https?://)([^/@\s:]+):([^/@\s]+)@", "$1$2:[REDACTED]@"),
    (r"sk-[A-Za-z0-9_\-]{16,}", "[REDACTED]"),
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case words of a-z, 0-9 and _, then the bigrams of runs of Chinese or Japanese characters (a run of one is itself). Null has none."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK})"), 1)
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), 1)
    return F.when(low.rlike(CJK), F.concat(words, F.flatten(pairs))).otherwise(words)


def lexical_terms(text: Column | str) -> Column:
    """Distinct lower-case terms such as numbers and part names, two characters or more, without closing dots and dashes."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-_.]+|[0-9０-９]+(?:\.[0-9０-９]+)*)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"[.\-_]+$", "")), lambda t: F.length(t) >= 2))


def clean_list(values: Column | str) -> Column:
    """Trimmed, non-empty and distinct, in order."""
    return F.array_distinct(F.filter(F.transform(col(values), lambda v: F.trim(v)), lambda v: v != ""))


@F.arrow_udf(StringType())
def _decode(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def decode_entities(text: Column | str) -> Column:
    return _decode(text)


def nfkc(text: Column | str) -> Column:
    return _nfkc(text)


SCRIPTS = r"(?is)<(script|style)\b.*?</\1\s*>"


def strip_html(text: Column | str) -> Column:
    """A feed's text: scripts, styles and tags go, before and after character references are decoded; white space becomes one space."""
    once = F.regexp_replace(F.coalesce(col(text), F.lit("")), SCRIPTS, " ")
    twice = F.regexp_replace(_decode(once), SCRIPTS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(twice, r"(?s)<[^>]+>", " "), r"\s+", " "))


def html_lines(text: Column | str) -> Column:
    """A page's text with a line for each block."""
    bare = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?is)<(script|style|noscript|svg|iframe|head)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|section|article|ul|ol|table|blockquote)\s*>", "\n")
    plain = _decode(F.regexp_replace(lines, r"(?s)<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^\S\n]+", " "), r" ?\n\s*", "\n"), r"^\s+|\s+$", "")


def html_title(text: Column | str, most: int = 300) -> Column:
    """The first title of a page, or an empty string."""
    return F.substring(F.trim(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, most)


def html_tables(text: Column | str) -> Column:
    """Flat tables of a page as arrays of rows of cell texts; empty rows and tables go."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " "))
    tables = F.regexp_extract_all(col(text), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), 1)
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), clean)
    rows = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1), cells), lambda r: F.size(r) > 0)
    return F.filter(F.transform(tables, rows), lambda t: F.size(t) > 0)


def safe_url(url: Column | str) -> Column:
    """The trimmed url if it is http or https with a host, else null."""
    u = F.trim(col(url))
    return F.when(u.rlike(r"(?i)^https?://[^/?#\s]+"), u)


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, port kept; user, fragment, closing slashes and tracking parameters go. What has no scheme is returned as it is.

    Values are re-encoded as forms are; a parameter without = gets one; the order and empty values stay.
    """
    u = F.trim(col(url))
    part = lambda pattern, k=1: F.regexp_extract(u, pattern, k)
    whole = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    host = F.lower(F.regexp_replace(part(whole, 2), r"^.*@", ""))
    path = F.when(part(whole, 3) == "", "/").otherwise(part(whole, 3))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    coded = lambda x: F.url_encode(F.url_decode(x))
    pairs = F.transform(F.filter(F.split(part(whole, 4), "&"), lambda p: p != ""), lambda p: F.struct(coded(F.substring_index(p, "=", 1)).alias("k"), coded(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    built = F.concat(F.lower(part(whole, 1)), F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), built).otherwise(col(url))


def redact(text: Column | str, known: list[str] = ()) -> Column:
    """Known values of six characters or more, longest first, and what looks like a secret become [REDACTED]."""
    out = col(text)
    for value in sorted({v for v in known if len(v) >= 6}, key=lambda v: (-len(v), v)):
        out = F.replace(out, F.lit(value), F.lit("[REDACTED]"))
    for pattern, stand_in in SECRETS:
        out = F.regexp_replace(out, pattern, stand_in)
    return out


def scrub(text: Column | str, most: int = 400_000) -> Column:
    """Without zero-width, bidirectional, tag and control characters (tab and newline stay), cut to a limit."""
    hidden = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]|[\x00-\x08\x0B-\x1F\x7F]"
    return F.substring(F.regexp_replace(col(text), hidden, ""), 1, most)


def slug(name: Column | str, default: str = "src") -> Column:
    found = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(found == "", default).otherwise(found)


def content_id(text: Column | str, prefix: str = "d", size: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(col(text), 256), 1, size))


def link_id(link: Column | str) -> Column:
    return F.substring(F.md5(col(link)), 1, 12)


def claim_text(text: Column | str) -> Column:
    """A claim's text for comparison: compatibility forms, single spaces, lower case, no closing punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(_nfkc(text)), r"\s+", " ")), r"[。.!?！？]+$", "")


def relation_key(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_nfkc(text), r"\s+", ""))


def excerpt(text: Column | str, at: Column, length: Column | int, around: int = 110) -> Column:
    """The text about position `at` (from 1), with dots where it is cut, on one line."""
    t, n = col(text), F.lit(length) if isinstance(length, int) else length
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + n + around - 1, F.length(t))
    body = F.replace(F.substring(t, first, last - first + 1), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(first > 1, "…").otherwise(""), body, F.when(last < F.length(t), "…").otherwise(""))


def representative(text: Column | str, most: int = 1600) -> Column:
    """A long text's beginning, middle and end, a third of the limit each."""
    t, part = col(text), most // 3
    middle = (F.length(t) / 2).cast("int") - part // 2 + 1
    return F.when(F.length(t) <= most, t).otherwise(F.concat_ws(" … ", F.substring(t, 1, part), F.substring(t, middle, F.lit(part)), F.substring(t, F.length(t) - part + 1, F.lit(part))))


def answer_and_thought(text: Column | str) -> Column:
    """struct(answer, thought): text in think tags is thought, closed or not; text before a lone closing tag is, too."""
    t = F.coalesce(col(text), F.lit(""))
    closed = F.regexp_extract_all(t, F.lit(r"(?is)<think>(.*?)</think>"), 1)
    rest = F.regexp_replace(t, r"(?is)<think>.*?</think>", "")
    lone = F.regexp_extract(rest, r"(?is)^(.*)</think>", 1)
    rest = F.regexp_replace(rest, r"(?is)^.*</think>", "")
    open_ = F.regexp_extract(rest, r"(?is)<think>(.*)$", 1)
    rest = F.regexp_replace(rest, r"(?is)<think>.*$", "")
    thought = F.filter(F.transform(F.concat(closed, F.array(lone, open_)), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(rest).alias("answer"), F.array_join(thought, "\n").alias("thought"))


def csv_guard(value: Column | str) -> Column:
    """A cell that a spreadsheet would run as a formula gets a leading quote."""
    v = col(value)
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


def looks_like_feed(text: Column | str) -> Column:
    head = F.lower(F.substring(F.coalesce(col(text), F.lit("")), 1, 2048))
    return head.rlike(r"<rss|<feed|<rdf|<channel|rss version") & ~F.ltrim(head).rlike(r"^(<!doctype html|<html)")


def citations(text: Column | str, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(r"(https?://[^\s)\]>\"']+)"), 1), lambda u: F.regexp_replace(u, r"[.,;。、]+$", ""))), 1, most)


def table_text(rows: Column | str) -> Column:
    return F.array_join(F.transform(col(rows), lambda r: F.array_join(r, " | ", "")), "\n")


def document_type(content_type: Column | str, url: Column | str) -> Column:
    """html, office formats, extensions, pdf, csv, json, other text: the first that fits."""
    kind, name = F.lower(F.coalesce(col(content_type), F.lit(""))), F.lower(F.regexp_replace(F.coalesce(col(url), F.lit("")), r"[?#].*$", ""))
    office = F.when(kind.contains("spreadsheetml"), "xlsx").when(kind.contains("wordprocessingml"), "docx").when(kind.contains("presentationml"), "pptx")
    by_name = F.nullif(F.regexp_extract(name, r"\.(xlsx|docx|pptx|pdf|csv|json)$", 1), F.lit(""))
    rest = F.when(kind.contains("pdf"), "pdf").when(kind.contains("csv"), "csv").when(kind.contains("json"), "json").when(kind.startswith("text/"), "text")
    return F.coalesce(F.when(kind.contains("html"), "html"), office, by_name, rest, F.lit("unknown"))


# Beginnings and ends of company names that a key leaves out.
COMPANY = r"^(株式会社|有限会社|合同会社|\(株\)|（株）)|(株式会社|有限会社|合同会社|\(株\)|（株）|,?(inc|corp|ltd|llc|co)\.?)$"
# Address ranges that no fetch may reach, as patterns of dotted numbers, and names of the same kind.
PRIVATE = r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\."
LOCAL_NAMES = r"(^|\.)(localhost|local|internal|localdomain)$"


def entity_key(name: Column | str, rounds: int = 4) -> Column:
    """A name for comparison: compatibility forms, no white space, lower case, without company forms at either end; never empty."""
    bare = F.lower(F.regexp_replace(_nfkc(name), r"\s+", ""))
    key = bare
    for _ in range(rounds):
        key = F.regexp_replace(key, COMPANY, "")
    return F.when(key == "", bare).otherwise(key)


def public_url(url: Column | str) -> Column:
    """Whether a url may be fetched: http or https, no user, a host with a dot that is neither private, local nor a disguised number."""
    u = F.lower(F.trim(col(url)))
    authority = F.regexp_extract(u, r"^https?://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":\d*$", "")
    numeric = host.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*\.?$")
    dotted = host.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    fine = (host != "") & ~authority.contains("@") & ~authority.contains("[") & host.contains(".") & ~host.rlike(LOCAL_NAMES) & (~numeric | (dotted & ~host.rlike(PRIVATE)))
    return F.coalesce(fine, F.lit(False))


def numbered_sources(text: Column | str) -> Column:
    """Of a report's last Sources heading: array of struct(n, title, url), each url once."""
    t = F.coalesce(col(text), F.lit(""))
    section = F.regexp_extract(t, r"(?is)^.*\n?#+\s*sources[^\n]*\n(.*)$", 1)
    section = F.regexp_replace(section, r"(?s)\n#+\s.*$", "")
    rows = F.filter(F.split(section, "\n"), lambda r: r.rlike(r"^\s*(?:[-*]\s*)?\[\d+\].*https?://"))
    found = F.transform(rows, lambda r: F.struct(F.regexp_extract(r, r"\[(\d+)\]", 1).cast("int").alias("n"), F.trim(F.regexp_extract(r, r"\]\s*(.*?):?\s*https?://", 1)).alias("title"), F.regexp_extract(r, r"(https?://[^\s)]+)", 1).alias("url")))
    none = F.array().cast("array<struct<n:int,title:string,url:string>>")
    return F.aggregate(found, none, lambda out, r: F.when(F.exists(out, lambda p: p["url"] == r["url"]), out).otherwise(F.concat(out, F.array(r))))


def unknown_citations(text: Column | str, known: Column) -> Column:
    """struct(text, removed): marks such as [S3] that the registry (an array of names) doesn't have are taken out."""
    t = F.coalesce(col(text), F.lit(""))
    marks = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[(S\d+)\]"), 1))
    gone = F.filter(marks, lambda m: ~F.array_contains(known, m))
    return F.struct(F.aggregate(gone, t, lambda out, m: F.replace(out, F.concat(F.lit("["), m, F.lit("]")), F.lit(""))).alias("text"), gone.alias("removed"))


# Labels of lines that describe a source.
LABELS = {"publisher": "発行(?:者|主体|元)", "published": "(?:発行|公表)(?:日|年月)?", "method": "調査方法", "geography": "(?:対象)?地域", "period": "(?:対象|調査)(?:期間|年月|時点)", "population": "(?:対象|母集団)", "definition": "定義", "source": "出典", "revision": "改定"}


def described(text: Column | str) -> Column:
    """struct of what a source's labelled lines say; null for labels that it lacks."""
    t = F.coalesce(col(text), F.lit(""))
    return F.struct(*(F.nullif(F.trim(F.regexp_extract(t, rf"(?m)^\s*{label}\s*[:：]\s*(.+)$", 1)), F.lit("")).alias(name) for name, label in LABELS.items()))


def mask_lines(text: Column | str) -> Column:
    """Labelled lines become blanks of the same length, so that places in the text stay."""
    every = r"^\s*(?:" + "|".join(LABELS.values()) + r")\s*[:：].*$"
    return F.array_join(F.transform(F.split(col(text), "\n"), lambda r: F.when(r.rlike(every), F.repeat(F.lit(" "), F.length(r))).otherwise(r)), "\n")
