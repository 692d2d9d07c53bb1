"""Ranked search, whitening and byte-level BPE against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparquill.llm import bpe, signatures, whitening
from tests.llm.test_llm import NULLS, SCHEMA, corpus, rows_of

# 11


def brute_search(docs, items, k=20):
    low = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    own = [(i, d, low(t)) for i, (d, t) in enumerate(docs)]
    own = [(i, d, c) for i, d, c in own if c]
    n, length = len(own), sum(c.total() for _, _, c in own)
    df = Counter(t for _, _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, d, c in own:
            m = 75 + 25 * c.total() * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in low(text).items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, i, d))
        out += [(item, r, d, -s) for r, (s, _, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "w1 w2 W3 the Éa É w1"), (2, None), (3, " .,"), (4, "nowhere"), (5, "w5 w6 w7 w8 w9 #x a|b w5"), (5, "the the w10"), (None, "w11 É")]


@pytest.mark.parametrize("terms", [signatures.TERMS, 3])
def test_search(spark, table, monkeypatch, terms):
    monkeypatch.setattr(signatures, "TERMS", terms)
    rows = corpus()
    found = signatures.search(table(rows, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string"), k=5)
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == brute_search([r[:2] for r in rows], ITEMS, 5)
    assert found.count() == 20


def test_bounds_are_never_below_scores():
    texts = [(t or "").encode() for _, t, *_ in corpus(n=40)]
    asked = [signatures.terms((t or "").encode()) for _, t in ITEMS]
    df = Counter(t for x in texts for t in signatures.terms(x))
    counts = [signatures.terms(t) for t in texts]
    own = signatures.Questions(asked, df, len(texts), sum(c.total() for c in counts))
    import pyarrow as pa

    seen = 0
    for batch in signatures._index(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.decode() for t in texts])], ["row", "text"])])):
        for row in batch.to_pylist():
            if row["slices"] is not None:
                bounds = own.bounds(row["bits"], np.array(row["sizes"]), row["slices"])
                for k, r in enumerate(row["rows"]):
                    assert (bounds[:, k] >= own.scores(texts[r], list(range(len(asked))))).all()
                    seen += 1
    assert seen == sum(bool(c) for c in counts)


def test_search_of_nothing(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert signatures.search(none, items).count() == 0
    assert signatures.search(table([(1, None, None, *NULLS)], SCHEMA), items).count() == 0
    assert signatures.search(table(corpus(n=3), SCHEMA), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# 12


def brute_white(rows, k=4):
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in good)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = fit - s / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in good], n, ((n * x.astype(object) - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("block, columns", [(whitening.BLOCK, whitening.COLUMNS), (7, 3)])
def test_whitening(table, monkeypatch, block, columns):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "COLUMNS", columns)
    r = np.random.default_rng(5)
    base = (r.normal(size=(90, 8)) * np.arange(8, 0, -1)).astype(np.float32).tolist()
    rows = [*((k, v, k, "x") for k, v in enumerate(base)), *((100 + k, base[0], 0, "x") for k in range(40)), (None, base[1], 0, None), (7, base[2], 0, ""), (200, None, 0, ""), (201, [float("nan")] * 8, 0, ""), (202, [None] + [0.0] * 7, 0, ""), (203, [float("inf")] * 8, 0, ""), (204, [1.5, 2.0], 0, "")]
    found = whitening.whiten(table(rows, "vec_id long, embedding array<float>, index long, x string")).toPandas()
    ids, n, deviation, white, share = brute_white([r[:2] for r in rows])
    assert len(found) == 4 * len(ids) and (found.n == n).all() and (found.identity_error <= 1e-9).all()
    assert np.allclose(found.groupby("component").explained.first(), share, rtol=1e-9)
    key = lambda i, d: (-1 if i is None or i != i else int(i), int(d))
    sign = None
    want = sorted(zip(map(key, ids, deviation), white.tolist(), strict=True))
    got = {}
    for row in found.itertuples():
        got.setdefault(key(row.vec_id, row.deviation), []).append((row.component, row.whitened))
    got = sorted((k, [w for c in range(4) for w in [sorted(x for x in v if x[0] == c + 1)[j][1]]]) for k, v in got.items() for j in range(len(v) // 4))
    assert [k for k, _ in got] == [k for k, _ in want]
    a, b = np.array([v for _, v in got]), np.array([v for _, v in want])
    sign = np.sign((a * b).sum(axis=0))
    assert np.allclose(a, b * sign, atol=1e-9)


def test_whitening_of_little(spark, table):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    flat = whitening.whiten(table([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [])], kind)).toPandas()
    assert sorted(set(flat.component)) == [1, 2] and flat.explained.sum() == pytest.approx(3.0)
    line = whitening.whiten(table([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).toPandas()
    assert list(line.component) == [1, 1] and set(line.explained) == {1.0} and set(line.deviation) == {512**2}


def test_deviations_beyond_long(table):
    kind = "vec_id long, embedding array<double>"
    found = whitening.whiten(table([(1, [1e300, 0.0]), (2, [1e7, 0.5]), (3, [-1e300, 2.0])], kind)).toPandas()
    first = found[found.component == 1].set_index("vec_id").deviation
    assert first.isna().all() and len(found) == 3  # beside such entries the others have no variance
    small = whitening.whiten(table([(1, [1e7, 0.5]), (2, [2e7, 0.0])], kind)).toPandas()
    assert set(small.deviation) == {(256 * 10**7) ** 2 + 128**2}


# 13

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(open(RANKS, "rb").read()), special_tokens={})


def test_byte_bpe(spark, table, plain):
    texts = [t for _, t, *_ in corpus()] + ["don't 's <|endoftext|> ", " " * 50 + "x", "漢字かな、カナ。" * 500, "🙂é\x00\x1f\x85 　x", "a" * 5000]
    docs = table([(k, t, None, *NULLS) for k, t in enumerate(texts)], SCHEMA)
    ranks = bpe.Ranks(spark, RANKS, public_tokenizers.PATTERN)
    coded = docs.select("doc_id", ranks.encoded("text", 300).alias("ids"))
    found = coded.select("doc_id", "ids", bpe.n_tokens("ids").alias("n"), ranks.decoded("ids").alias("bytes")).collect()
    assert len(found) == len(texts)
    for row in found:
        want = plain.encode_ordinary(texts[row.doc_id] or "")
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.n == len(want) and bytes(row.bytes) == (texts[row.doc_id] or "").encode()
    assert docs.limit(0).select(ranks.encoded("text")).count() == 0
    assert spark.createDataFrame([(None,)], "ids binary").select(ranks.decoded("ids").alias("b")).first().b == b""


@pytest.mark.parametrize("most", [1, 2, 5, 40])
def test_pieces_meet_the_pattern(plain, most, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 4)
    monkeypatch.setattr(bpe, "LONG_RUN", re.compile(f"[{bpe.WHITE}]{{4,}}"))
    r = np.random.default_rng(most)
    signs = list("ab1 ' '  \n\t.,'s-!漢か、。é　\x85\x1c🙂") + ["'re", "     ", " \n  "]
    for _ in range(300):
        text = "".join(r.choice(signs) for _ in range(int(r.integers(0, 60))))
        want = plain.encode_ordinary(text)
        assert "".join(p for p, _ in bpe.pieces(text, most)) == text
        got = np.frombuffer(bpe.encode(plain, text, most), "<u4").tolist()
        assert got == want, text
        assert bpe.decode(plain, np.array(want, "<u4").tobytes(), 3) == text.encode()


def test_runs_that_the_pattern_cannot_take(plain):
    text = "x" + " " * 1_500_000 + "y" + "\n" * 200_000
    ids = bpe.encode(plain, text)
    assert hashlib.sha256(bpe.decode(plain, ids)).digest() == hashlib.sha256(text.encode()).digest()
    assert np.frombuffer(ids, "<u4")[:1].tolist() == plain.encode_ordinary("x")
