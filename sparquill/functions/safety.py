"""Text that people or models see: cleaned pages, boundaries, guards, citations and listings."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col

# Elements that are dropped with their content, that may be shown, and that begin a line.
DANGEROUS = frozenset("script style iframe frame frameset object embed applet form noscript meta link base".split())
SHOWN = frozenset("b strong i em u br p ul ol li table tr td th".split())
LINES = frozenset("p div br tr li h1 h2 h3 h4 table".split())
VOID = frozenset("br frame embed meta link base".split())
# The mark of foreign text, and what a forged one becomes.
BOUNDARY, FORGED = "UNTRUSTED-DOCUMENT", "UNTRUSTED-DOC-ESCAPED"
# Weights of a rule-based judge.
JUDGE = {"coverage": 0.3, "specificity": 0.3, "evidence": 0.25, "relevance": 0.15}


class _Walk(HTMLParser):
    """A page without its dangerous elements, as lines of text or as allowed tags without attributes."""

    def __init__(self, shown: bool):
        super().__init__(convert_charrefs=True)
        self.shown, self.out, self.skipped = shown, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipped or tag in DANGEROUS:
            if tag not in VOID:
                self.skipped.append(tag)
        elif self.shown:
            self.out.append(f"<{tag}>" if tag in SHOWN else "")
        elif tag in LINES:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
        elif self.shown:
            self.out.append(f"</{tag}>" if tag in SHOWN and tag not in VOID else "")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(html.escape(data) if self.shown else data)


def _walked(page: str | None, shown: bool) -> str:
    walk = _Walk(shown)
    walk.feed(page or "")
    walk.close()
    text = "".join(walk.out)
    return text if shown else re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()


@F.arrow_udf(StringType())
def tree_text(pages: pa.Array) -> pa.Array:
    """A page's text by its elements: dangerous ones and comments go, blocks begin lines. The nesting needs a parser, so this runs over Arrow batches."""
    return pa.array([_walked(p, False) for p in pages.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def displayable(pages: pa.Array) -> pa.Array:
    """A page for display: allowed tags without attributes, all other tags peeled off, text escaped."""
    return pa.array([_walked(p, True) for p in pages.to_pylist()], pa.string())


def bare_text(text: Column | str) -> Column:
    """A definition for comparison: without white space and punctuation, in lower case. Full-width digits stay."""
    return F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\s、。,.　・:：/／()（）「」\"']+", ""))


def bounded(text: Column | str, token: Column, most: int = 20_000) -> Column:
    """Foreign text between two marks with a token; marks within it are defused."""
    body = F.replace(F.substring(F.coalesce(col(text), F.lit("")), 1, most), F.lit(BOUNDARY), F.lit(FORGED))
    mark = F.concat(F.lit(f"{BOUNDARY}-"), token)
    return F.concat(F.lit("<<<"), mark, F.lit(">>>\n"), body, F.lit("\n<<<END-"), mark, F.lit(">>>"))


def guard(text: Column | str, most: int = 20_000, banned: list[str] = ()) -> Column:
    """Why a text doesn't pass, or null: it is empty, too long, or has a banned word."""
    t = F.coalesce(col(text), F.lit(""))
    out = F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", "empty").when(F.length(t) > most, "too long")
    for word in filter(None, map(str.strip, banned)):
        out = out.when(F.contains(t, F.lit(word)), f"banned: {word}")
    return out


def judged(text: Column | str, cited: Column) -> Column:
    """struct(coverage, specificity, evidence, relevance, score) by what a text shows: numbers with units, comparison, recency, citations."""
    t = F.coalesce(col(text), F.lit(""))
    number = t.rlike(r"[+\-]?\d[\d,\.]*\s*(%|倍|件|億|万|人|社)").cast("int")
    compared, recent = t.rlike("比較|トレードオフ|対照|優位").cast("int"), t.rlike("最新|近年|動向|トレンド").cast("int")
    own = {"coverage": 0.5 + 0.2 * compared + 0.15 * recent, "specificity": 0.35 + 0.4 * number + 0.15 * compared, "evidence": 0.2 + 0.65 * cited.cast("int"), "relevance": F.lit(0.7)}
    own = {k: F.least(F.round(v, 3), F.lit(1.0)) for k, v in own.items()}
    return F.struct(*(v.alias(k) for k, v in own.items()), F.round(sum((JUDGE[k] * v for k, v in own.items()), F.lit(0.0)), 3).alias("score"))


def citation(ref: Column, title: Column, text: Column, score: Column, most: int = 200) -> Column:
    """struct(ref, title, snippet, score) of a passage."""
    return F.struct(ref.alias("ref"), title.alias("title"), F.substring(text, 1, most).alias("snippet"), F.round(score, 4).alias("score"))


def extracts(passages: DataFrame, by: str, rank: str, title: str, text: str, most: int = 4, chars: int = 400) -> DataFrame:
    """(by, answer): the first passages, cut and numbered [S1], [S2] and so on."""
    best = passages.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(rank))).where(F.col("_k") <= most)
    line = F.concat(F.lit("[S"), F.col("_k"), F.lit("] "), F.col(title), F.lit(": "), F.substring(text, 1, chars))
    lines = F.array_sort(F.collect_list(F.struct("_k", line.alias("line"))))
    return best.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("answer"))


def differences(a: Column, b: Column) -> Column:
    """How two pieces of evidence differ (structs with definition, year, geography, method and population): an array of names, ['unknown'] if in nothing."""
    said = lambda f: (F.coalesce(a[f], F.lit("")) != "") & (F.coalesce(b[f], F.lit("")) != "")
    texts = lambda f: said(f) & (bare_text(a[f]) != bare_text(b[f]))
    one = (F.coalesce(a["method"], F.lit("")) != "") != (F.coalesce(b["method"], F.lit("")) != "")
    found = {"definition": texts("definition"), "time": F.coalesce(a["year"] != b["year"], F.lit(False)), "geography": said("geography") & (a["geography"] != b["geography"]), "method": one | (said("method") & (a["method"] != b["method"])), "population": texts("population")}
    names = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in found.items())), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("unknown")))


def tree_lines(paths: DataFrame, doc: str, order: str, depth: str, title: str) -> DataFrame:
    """(doc, tree): an outline's titles as indented lines, in order."""
    line = F.concat(F.repeat(F.lit("  "), F.col(depth).cast("int")), F.col(title))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return paths.groupBy(doc).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("tree"))
