"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown here on a bounded sample of labelled rows (`MAX_LABELLED`, the rows of least hash), with histograms and monotonic constraints,
and flattened into numpy node arrays that score whole Arrow batches.

Defined results: a null or empty text has no words and fails the base rule; null labels are left out; without labels of both classes the trees give
no verdict and whatever passes the base rule is kept; repeated rows are scored alike; other columns of the input are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import raw

#: The classifier is fitted on at most so many labelled rows; statistics and verdicts cover all rows.
MAX_LABELLED = 8000
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = "struct<" + "".join(f"{c}: bigint, " for c in COUNTS) + "base_failed: boolean, score: double, kept: boolean>"
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "digits", "line_words")
#: More symbols, repeated lines or repeated windows never raise the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
UPPER, MARKS, DIGITS = bytes(range(65, 91)), b"!?;:", b"0123456789"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that occur twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    code = own[: n - window + 1]
    for k in range(1, window):
        code = np.unique(code * len(ids) + own[k : n - window + 1 + k], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(code)[code] > 1)
    hit = np.zeros(n, bool)
    for k in range(window):
        hit[twice + k] = True
    return int(hit.sum())


def statistics(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts and the features of one text."""
    text = text or b""
    words, count = text.split(), lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    counts = (len(words), len(b"".join(words).decode("utf-8", "replace")), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words))
    n, chars = max(1, counts[0]), max(1, counts[1])
    return counts, (np.log1p(counts[0]), counts[1] / n, counts[2] / chars, counts[3] / max(1, len(lines)), counts[4] / n, count(UPPER) / chars, count(MARKS) / chars, count(DIGITS) / chars, n / max(1, len(lines)))


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points at itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row of features."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, least: int = 10, ridge: float = 1.0) -> Trees:
    """Histogram boosting for the logistic loss. A split on a constrained feature must order its children, and bounds pass down the tree, so that the
    whole tree is monotonic in it."""
    mean = y.mean() if len(y) else 1.0
    base = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (20.0 if mean else -20.0)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        feature.append(0), threshold.append(0.0), left.append(len(left)), right.append(len(right)), value.append(0.0)
        return len(value) - 1

    if 0 < mean < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            best = lambda gs, hs: gs / (hs + ridge)

            def split(rows: np.ndarray, low: float, high: float, level: int) -> int:
                k, gs, hs = node(), g[rows].sum(), h[rows].sum()
                value[k] = float(np.clip(best(gs, hs), low, high)) * rate
                choice = None
                for j in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
                    size = len(cuts[j]) + 1
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                    if not len(gl):
                        continue
                    vl, vr = np.clip(best(gl, hl), low, high), np.clip(best(gs - gl, hs - hl), low, high)
                    gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + (gs - gl) * vr - 0.5 * (hs - hl + ridge) * vr**2
                    gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                    at = int(np.argmax(gain))
                    if np.isfinite(gain[at]) and (choice is None or gain[at] > choice[0] + 1e-12):
                        choice = (gain[at], j, at, vl[at], vr[at])
                v = value[k] / rate
                if choice and choice[0] > gs * v - 0.5 * (hs + ridge) * v**2 + 1e-6:
                    _, j, at, vl, vr = choice
                    middle, here = (vl + vr) / 2, binned[rows, j] <= at
                    feature[k], threshold[k] = j, float(cuts[j][at])
                    ends = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
                    left[k], right[k] = split(rows[here], *ends[0], level + 1), split(rows[~here], *ends[1], level + 1)
                return k

            first = len(value)
            roots.append(split(np.arange(len(y)), -np.inf, np.inf, 0))
            one = Trees(0.0, np.array([first]), *map(np.array, (feature, threshold, left, right, value)), depth)
            score += one.score(x)
    return Trees(base, np.array(roots, np.int64), *(np.array(v, t) for v, t in ((feature, np.int64), (threshold, float), (left, np.int64), (right, np.int64), (value, float))), depth)


@F.arrow_udf(ArrayType(DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t)[1] for t in raw(texts)], pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", most: int = MAX_LABELLED) -> Trees:
    """Trees for the labels. The sample has at most `most` rows, so broadcasting its ids and training on the driver are bounded."""
    sample = labels.select(F.col(id).alias("_id"), F.col(label).cast("double").alias("_y")).dropna().orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").limit(4 * most).select("_id", "_y", _features("_text").alias("_x")).collect()
    rows.sort(key=lambda r: (r._id, r._y, tuple(r._x)))
    x = np.array([r._x for r in rows], float).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([r._y > 0 for r in rows], float), [MONOTONE.get(f, 0) for f in FEATURES])


def verdict(text: Column | str, trees: Trees) -> Column:
    """A struct for each text: the counts, base_failed, score (log odds) and kept."""

    @F.arrow_udf(VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        found = [statistics(t) for t in raw(texts)]
        counts = np.array([c for c, _ in found], np.int64).reshape(len(found), len(COUNTS))
        score = trees.score(np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        return pa.StructArray.from_arrays([*(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0))], [*COUNTS, "base_failed", "score", "kept"])

    return judge.asNondeterministic()(text)  # else a filter on it would run it twice
