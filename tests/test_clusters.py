"""Similarity joins and clusters against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from sparquill.operators import clusters, search


def titles(seed, n):
    r = random.Random(seed)
    words = ["market", "size", "of", "coffee", "in", "2024", "Japan", "report", "推計", "人口", "é", "x"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(n)]
    return [*base, *(t[:-1] + r.choice("abc") for t in base[: n // 2]), "", None, base[0], base[0]]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.95])
def test_no_similar_pair_is_lost(spark, least):
    rows = [(k, "ab"[k % 2] if k % 11 else None, t) for k, t in enumerate(titles(3, 40))]
    found = clusters.similar_pairs(spark.createDataFrame(rows, "id long, g string, t string"), ["g"], "t", least)
    kept = [tuple(r) for r in found.select("g", "a", "b").collect()]
    own = {(g, t) for _, g, t in rows if g and t}
    want = {(g, a, b) for g, a in own for h, b in own if g == h and a < b and SequenceMatcher(None, a, b).quick_ratio() >= least}
    assert len(kept) == len(set(kept)) and set(kept) == want and want


def test_no_similar_pair_is_lost_between_tiles(spark, monkeypatch):
    """Groups of over FEW texts meet as tiles; here of 16 texts."""
    monkeypatch.setattr(clusters, "FEW", 5)
    monkeypatch.setattr(clusters, "TILE", 16)
    rows = [(k, ("a", "b", f"few{k % 40}")[k % 3], t) for k, t in enumerate(titles(4, 120))]
    found = clusters.similar_pairs(spark.createDataFrame(rows, "id long, g string, t string"), ["g"], "t", 0.75)
    kept = [tuple(r) for r in found.select("g", "a", "b", "most").collect()]
    own = {(g, t) for _, g, t in rows if t}
    want = {(g, a, b, round(SequenceMatcher(None, a, b).quick_ratio(), 9)) for g, a in own for h, b in own if g == h and a < b and SequenceMatcher(None, a, b).quick_ratio() >= 0.75}
    assert len(kept) == len(set(kept)) and set(kept) == want and want


def test_similar_pairs_broadcast_no_texts(spark):
    """Exploded characters with their texts once passed for a small table and were broadcast: 40 titles of 60 characters made over 1000 rows."""
    rows = [(k, "s", f"{k:03d}" + "abcdefghij" * 6) for k in range(40)]
    found = clusters.similar_pairs(spark.createDataFrame(rows, "id long, g string, t string"), ["g"], "t", 0.75)
    assert found.count() == 40 * 39 // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def brute(rows, least):
    root = {r[0]: r[0] for r in rows}
    while True:
        before = dict(root)
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[1] is not None and a[1] == b[1]:
                    same = a[2] and a[2] == b[2] or a[3] is not None and a[3] == b[3] and a[4] and b[4] and SequenceMatcher(None, min(a[4], b[4]), max(a[4], b[4])).ratio() >= least
                    if same:
                        root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
        if root == before:
            return root


def test_evidence_clusters(spark):
    rows = [(k, "pq"[k % 2] if k % 13 else None, ("h%d" % (k % 9)) if k % 4 == 0 else ("" if k % 5 else None), k % 3 if k % 7 else None, t) for k, t in enumerate(titles(5, 30))]
    found = clusters.evidence_clusters(spark.createDataFrame(rows, "id long, p string, h string, v int, t string"), "id", "p", ["h"], ["v"], "t")
    assert {r.id: r.cluster for r in found.collect()} == brute(rows, 0.75)


def test_keywords_of_any_length(spark):
    index = [(1, ["Ab", "coffee"]), (2, ["offe", ""]), (3, None), (4, ["日本経済"]), (5, ["x" * 40])]
    asked = [(1, "COFFEE in cab"), (2, "日本経済新聞"), (3, None), (4, ""), (5, "x" * 41), (1, "ab")]
    found = search.keyword_hits(spark.createDataFrame(index, "k long, w array<string>"), spark.createDataFrame(asked, "q long, t string"), "w", "q", "t")
    want = sorted((q, k) for q, t in asked if t is not None for k, w in index if any(x.lower() in t.lower() for x in w or ()))
    assert sorted(tuple(r) for r in found.collect()) == want
