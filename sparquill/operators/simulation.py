"""Monte-Carlo estimation as DataFrame work: draws are expressions of hashes, so they are the same however they are dealt, and never leave the executors."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import overlap
from . import formula, statistics

#: The 90th percentile of the standard normal distribution.
Z90 = 1.2815515655446004
# Coefficients of a rational approximation of the normal quantile (relative error under 1.2e-9).
A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def uniform(name: str, seed: int, *keys: Column) -> Column:
    """A number strictly between 0 and 1 that the name, the seed and the keys fix."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _poly(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + k
    return out


def normal(u: Column) -> Column:
    """The normal quantile."""
    q = u - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(u)), F.sqrt(-2 * F.log(1 - u))
    return F.when(u < 0.02425, _poly(C, low) / _poly(D, low)).when(u > 1 - 0.02425, -_poly(C, high) / _poly(D, high)).otherwise(_poly(A, r) * q / _poly(B, r))


def draw(kind: str, u: Column, low: Column, central: Column, high: Column) -> Column:
    """A distribution's quantile at u; low and high are its P10 and P90."""
    if kind == "fixed":
        return central
    if kind == "uniform":
        edge = (high - low) / 8  # P10 to P90 are four fifths of the range
        return low - edge + u * (high - low + 2 * edge)
    if kind == "loguniform":
        return F.exp(draw("uniform", u, F.log(low), F.log(central), F.log(high)))
    if kind == "lognormal":
        return F.exp((F.log(low) + F.log(high)) / 2 + normal(u) * (F.log(high) - F.log(low)) / (2 * Z90))
    if kind == "triangular":
        a, b = low - (high - low) / 4, high + (high - low) / 4
        c = F.least(F.greatest(central, a), b)
        turn = F.try_divide(c - a, b - a)
        return F.when(turn.isNull(), c).when(u < turn, a + F.sqrt(u * (b - a) * (c - a))).otherwise(b - F.sqrt((1 - u) * (b - a) * (b - c)))
    raise ValueError(f"no distribution {kind!r}")


def correlated(names: list[str], correlation: np.ndarray, seed: int, *keys: Column) -> dict[str, Column]:
    """Uniform numbers whose normal scores have the correlation matrix, which must be positive semidefinite."""
    if np.linalg.eigvalsh(correlation).min() < -1e-10:
        raise ValueError("the correlation matrix is not positive semidefinite")
    root = np.linalg.cholesky(correlation + 1e-10 * np.eye(len(names)))
    z = [normal(uniform(n, seed, *keys)) for n in names]
    return {n: cdf(sum((float(w) * x for w, x in zip(root[k][: k + 1], z, strict=False)), F.lit(0.0))) for k, n in enumerate(names)}


def cdf(z: Column) -> Column:
    """The normal distribution function, to about 1e-7, kept inside (0, 1)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / float(np.sqrt(2 * np.pi)) * t * _poly((1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), t)
    return F.least(F.greatest(F.when(z > 0, 1 - tail).otherwise(tail), F.lit(1e-12)), F.lit(1 - 1e-12))


def simulate(models: DataFrame, key: str, text: str, kinds: dict[str, str], iterations: int, seed: int) -> DataFrame:
    """(key, i, parameters, y): the formula over draws for each model; columns <name>_low, <name>_mid and <name>_high give each parameter."""
    rows = models.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    for name, kind in kinds.items():
        rows = rows.withColumn(name, draw(kind, uniform(name, seed, F.col(key).cast("string"), F.col("i")), *(F.col(f"{name}_{x}") for x in ("low", "mid", "high"))))
    return rows.select(key, "i", *kinds, formula.column(text, {n: F.col(n) for n in kinds}).alias("y"))


def summary(draws: DataFrame, key: str, value: str = "y") -> DataFrame:
    """(key, n, failed, mean, std, p05, p10, p50, p90, p95) of the finite results."""
    fine = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    q = statistics.quantiles(draws.where(fine), [key], value, {"p05": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95})
    moments = draws.groupBy(key).agg(F.count_if(~F.coalesce(fine, F.lit(False))).alias("failed"), F.avg(F.when(fine, F.col(value))).alias("mean"), F.stddev_pop(F.when(fine, F.col(value))).alias("std"))
    return moments.join(q, key, "left")


def sensitivity(models: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, name, low, high, span, elasticity, rank, share): the formula with one parameter at its P10 and P90 and the others in the middle; elasticity
    is the central difference of 1 %."""
    middle = {n: F.col(f"{n}_mid") for n in names}
    at = lambda n, v: formula.column(text, middle | {n: v})
    base = formula.column(text, middle)
    parts = []
    for n in names:
        mid = middle[n]
        slope = F.when((base != 0) & (mid != 0), F.try_divide(at(n, mid * 1.01) - at(n, mid * 0.99), 0.02 * base))
        parts.append(F.struct(F.lit(n).alias("name"), at(n, F.col(f"{n}_low")).alias("low"), at(n, F.col(f"{n}_high")).alias("high"), slope.alias("elasticity")))
    rows = models.select(key, F.inline(F.array(*parts))).withColumn("span", F.abs(F.col("high") - F.col("low")))
    w = Window.partitionBy(key)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("span"), "name"))).withColumn("share", F.try_divide("span", F.sum("span").over(w)))


def agreement(a_low: Column, a_mid: Column, a_high: Column, b_low: Column, b_mid: Column, b_high: Column) -> Column:
    """struct(ratio, overlap, verdict) of two estimates of one thing."""
    ratio = F.try_divide(F.greatest(a_mid, b_mid), F.least(a_mid, b_mid))
    shared = overlap(a_low, a_high, b_low, b_high)
    verdict = F.when((ratio <= 1.8) & (shared >= 0.3), "consistent").when(ratio <= 3, "moderate").otherwise("discrepant")
    return F.struct(ratio.alias("ratio"), shared.alias("overlap"), verdict.alias("verdict"))


def scenarios(models: DataFrame, key: str, text: str, names: list[str], results: DataFrame | None = None, custom: dict[str, Column] | None = None) -> DataFrame:
    """(key, kind, value): bear, base and bull are P10, P50 and P90 of `results` (summary's rows); extreme_low and extreme_high put every parameter at the
    end that lowers or raises the result, which a run with that parameter alone at each end tells, so a divisor's high end lowers; custom takes values for
    some parameters and the middle of the others.

    Ends that are missing are the middle. Where a run has no result the two extremes are left out; other kinds without one are null. All is one row a model,
    without a shuffle but for joining `results`.
    """
    middle = {n: F.col(f"{n}_mid").cast("double") for n in names}
    low, high = ({n: F.coalesce(F.col(f"{n}_{end}").cast("double"), middle[n]) for n in names} for end in ("low", "high"))
    runs = {n: (formula.column(text, middle | {n: low[n]}), formula.column(text, middle | {n: high[n]})) for n in names}
    rising = models.withColumns({f"_{n}": a <= b for n, (a, b) in runs.items()} | {"_runs": F.lit(True) if not runs else reduce(lambda x, y: x & y, [a.isNotNull() & b.isNotNull() for a, b in runs.values()])})
    worst = {n: F.when(F.col(f"_{n}"), low[n]).otherwise(high[n]) for n in names}
    best = {n: F.when(F.col(f"_{n}"), high[n]).otherwise(low[n]) for n in names}
    kinds = {}
    if results is not None:
        rising = rising.join(results.select(key, F.col("p10").alias("_p10"), F.col("p50").alias("_p50"), F.col("p90").alias("_p90")), key, "left")
        kinds |= {"bear": F.col("_p10"), "base": F.col("_p50"), "bull": F.col("_p90")}
    kinds |= {"extreme_low": formula.column(text, worst), "extreme_high": formula.column(text, best)}
    if custom:
        kinds["custom"] = formula.column(text, middle | custom)
    rows = rising.select(key, "_runs", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))))
    extreme = F.col("kind").startswith("extreme")
    return rows.where(~extreme | F.col("_runs") & F.col("value").isNotNull()).select(key, "kind", "value")
