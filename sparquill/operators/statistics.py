"""Exact quantiles, ranks, correlation and fusion of values in groups, without a group in one task.

Equal values of a group are added up before anything else. Distinct values are dealt to ranges of their order that Spark balances from a sample, so
that neither outliers nor a long tail nor one hot group gathers in a task; running sums over the ranges' totals (a few rows for each group) give where
each range begins, and only within a range are values ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage


def running(values: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Adds _before (weight of the smaller values of the group) and _all (weight of the group) to rows with distinct values of a group."""
    placed = stage(values.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    ranges = Window.partitionBy(*by)
    starts = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_start"), F.sum("_sum").over(ranges).alias("_all"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0.0)))
    return placed.join(starts, [*by, "_range"]).withColumn("_before", F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_range")


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, at: dict[str, float], order: list[str]) -> DataFrame:
    """Quantiles between the centres of weights: a row of weight w stands at (weight before it + w / 2) / all; in between they are linear, and the
    ends hold beyond. Of equal values the first and last row in order bound the step. Rows without a positive weight go."""
    rows = rows.where((F.col(weight) > 0) & F.col(value).isNotNull())
    ends = F.struct(*order)
    w = F.col(weight).cast("double")
    steps = rows.groupBy(*by, value).agg(F.sum(w).alias("_w"), F.min_by(w, ends).alias("_first"), F.max_by(w, ends).alias("_last"))
    placed = running(steps, by, value, "_w")
    placed = placed.withColumn("_a", (F.col("_before") + F.col("_first") / 2) / F.col("_all")).withColumn("_b", (F.col("_before") + F.col("_w") - F.col("_last") / 2) / F.col("_all"))
    below, above = F.struct(F.col("_b").alias("c"), F.col(value).alias("v")), F.struct(F.col("_a").alias("c"), F.col(value).alias("v"))
    found = placed.groupBy(*by).agg(
        *(f for name, q in at.items() for f in (F.max(F.when(F.col("_b") <= q, below)).alias(f"{name}_a"), F.min(F.when(F.col("_a") > q, above)).alias(f"{name}_b"), F.max(F.when((F.col("_a") <= q) & (F.col("_b") > q), F.col(value))).alias(f"{name}_in")))
    )

    def mix(name: str, q: float) -> Column:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        between = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (q - a["c"]) / (b["c"] - a["c"]))
        return F.coalesce(F.col(f"{name}_in").cast("double"), between)

    return found.select(*by, *(mix(n, q).alias(n) for n, q in at.items()))


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Linear quantiles: at place q * (n - 1) of the ordered values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").cast("double").alias("_n"))
    placed = running(counts, by, value, "_n")
    place = lambda q: F.col("_all") * q - q
    here = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(value)))
    found = placed.groupBy(*by).agg(F.first("_all").alias("_n"), *(f for name, q in at.items() for f in (here(F.floor(place(q) + 1e-9)).alias(f"{name}_a"), here(F.ceil(place(q) - 1e-9)).alias(f"{name}_b"))))

    def mix(name: str, q: float) -> Column:
        at_ = F.col("_n") * q - q
        return F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (at_ - F.floor(at_ + 1e-9))

    return found.select(*by, F.col("_n").cast("long").alias("n"), *(mix(n, q).alias(n) for n, q in at.items()))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name): the mean rank of each value among its group's."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").cast("double").alias("_n"))
    return running(counts, by, value, "_n").select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation in each group; 0 where a side is constant."""
    full = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = full.join(average_ranks(full, by, a, "_ra"), [*by, a]).join(average_ranks(full, by, b, "_rb"), [*by, b])
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return ranked.groupBy(*by).agg(F.when(spread > 0, F.covar_pop("_ra", "_rb") / spread).otherwise(0.0).alias("spearman"))


def log_fences(rows: DataFrame, by: list[str], value: str, reach: float = 3.0) -> DataFrame:
    """(by, low, high): outlier fences on logarithms, for groups of four or more that are all positive; others have none."""
    usable = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least")).where("n >= 4 AND least > 0").select(*by)
    logs = rows.join(usable, by, "left_semi").withColumn("_log", F.log(value))
    q = quantiles(logs, by, "_log", {"a": 0.25, "b": 0.75})
    spread = reach * (F.col("b") - F.col("a"))
    return q.select(*by, F.exp(F.col("a") - spread).alias("low"), F.exp(F.col("b") + spread).alias("high"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int = 40) -> DataFrame:
    """(by, bin, n): equal bins between minimum and maximum, the last one closed."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    place = F.when(spread > 0, F.least(F.floor((F.col(value) - F.col("_low")) / spread * bins), F.lit(bins - 1))).otherwise(0)
    return rows.where(F.col(value).isNotNull()).join(ends, by).groupBy(*by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fuse(evidence: DataFrame, by: str, value: str, weight: str, order: str) -> DataFrame:
    """One estimate for each parameter from weighted values: median with P10 and P90, widened to 15 % each way where they lie within 10 %; a single
    value gets half as much again each way. confidence grows with the mean weight and the number of values."""
    q = weighted_quantiles(evidence, [by], value, weight, {"low": 0.1, "median": 0.5, "high": 0.9}, [order])
    base = evidence.where(F.col(weight) > 0).groupBy(by).agg(F.count("*").alias("n"), F.avg(weight).alias("mean"))
    narrow = F.col("high") / F.col("low") < 1.1
    low = F.when(F.col("n") == 1, F.col("median") / 1.5).when(narrow, F.col("median") / 1.15).otherwise(F.col("low"))
    high = F.when(F.col("n") == 1, F.col("median") * 1.5).when(narrow, F.col("median") * 1.15).otherwise(F.col("high"))
    confidence = F.least(F.lit(1.0), F.col("mean") / 100 * (1 + 0.05 * (F.col("n") - 1)))
    return q.join(base, by).select(by, "n", low.alias("low"), "median", high.alias("high"), confidence.alias("confidence"))


def incompatible(geography: Column, wanted_geography: Column, period: Column, wanted_period: Column) -> Column:
    """Why evidence can't be fused: 'geography' where both are known and neither holds the other, 'period' where both are known and differ, else null."""
    a, b = F.trim(F.coalesce(geography, F.lit(""))), F.trim(F.coalesce(wanted_geography, F.lit("")))
    apart = (a != "") & (b != "") & ~a.contains(b) & ~b.contains(a)
    return F.when(apart, "geography").when((period != "") & (wanted_period != "") & (period != wanted_period), "period")


def usable(evidence: DataFrame, by: str, score: str, accepted: str, reason: str, year: str, cluster: str, id: str, reference: int, least: float = 20.0, stale: int = 8, good: float = 50.0) -> DataFrame:
    """Evidence that may be fused: accepted, compatible (reason is null) and with a score of `least`; where a parameter has good evidence of the last
    `stale` years, older evidence goes (a year that is unknown stays); of each cluster the best one stays, the first on a tie."""
    rows = evidence.where(F.col(accepted) & F.col(reason).isNull() & (F.col(score) >= least))
    recent = (F.lit(reference) - F.col(year) <= stale) & (F.col(score) >= good)
    marked = rows.join(rows.groupBy(by).agg(F.coalesce(F.bool_or(recent), F.lit(False)).alias("_recent"), F.count("*").alias("_n")), by)
    kept = marked.where(~(F.col("_recent") & (F.col("_n") >= 2) & F.coalesce(F.lit(reference) - F.col(year) > stale, F.lit(False)))).drop("_recent", "_n")
    own = F.coalesce(F.nullif(F.col(cluster).cast("string"), F.lit("")), F.concat(F.lit("#"), F.col(id).cast("string")))
    rest = F.struct(*(c for c in evidence.columns if c != by))
    return kept.groupBy(by, own.alias("_cluster")).agg(F.min_by(rest, F.struct(-F.col(score), F.col(id))).alias("_r")).select(by, "_r.*")


def estimates(parameters: DataFrame, evidence: DataFrame, by: str, value: str, weight: str, order: str, low: str, high: str, reach: float = 3.0) -> DataFrame:
    """(by, n, low, central, high, distribution, confidence) of every parameter from evidence that may be fused (see usable), with its own ends `low` and
    `high` or nulls; one without evidence has n 0 and nulls, and no value is made up.

    Outliers on logarithms go first. A single value keeps its own range where both ends are there, else gets half as much again each way (where it isn't
    positive, half its size each way, or 1). Of several the weighted median with P10 and P90, on logarithms where all are positive, and 15 % each way where
    they lie within 10 %. Values that aren't all positive are triangular, a range of over ten times is log-uniform, others are log-normal.
    """
    fences = log_fences(evidence.where(F.col(value).isNotNull() & (F.col(weight) > 0)), [by], value, reach).select(by, F.col("low").alias("_least"), F.col("high").alias("_most"))
    kept = evidence.where(F.col(value).isNotNull() & (F.col(weight) > 0)).join(fences, by, "left")
    kept = stage(kept.where(F.col("_least").isNull() | F.col(value).between(F.col("_least"), F.col("_most"))).drop("_least", "_most"))
    one = F.min_by(F.struct(F.col(value).cast("double").alias("v"), F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high")), order)
    groups = kept.groupBy(by).agg(F.count("*").alias("n"), F.avg(weight).alias("_mean"), (F.min(value) > 0).alias("_positive"), one.alias("_one"))
    logs = kept.join(groups.select(by, (F.col("_positive") & (F.col("n") > 1)).alias("_log")), by)
    logs = logs.withColumn("_x", F.when(F.col("_log"), F.log(value)).otherwise(F.col(value)))
    q = weighted_quantiles(logs, [by], "_x", weight, {"_low": 0.1, "_mid": 0.5, "_high": 0.9}, [order]).join(groups, by)
    back = {c: F.when(F.col("_positive") & (F.col("n") > 1), F.exp(c)).otherwise(F.col(c)) for c in ("_low", "_mid", "_high")}
    q = q.withColumns(back)
    mid, single, positive = F.col("_mid"), F.col("n") == 1, F.col("_positive")
    own = single & F.col("_one.low").isNotNull() & F.col("_one.high").isNotNull()
    half = F.when(mid == 0, 1.0).otherwise(F.abs(mid) * 0.5)
    narrow = positive & (F.col("_high") / F.col("_low") < 1.1)
    ends = {
        "low": F.when(own, F.col("_one.low")).when(single & positive, mid / 1.5).when(single, mid - half).when(narrow, mid / 1.15).otherwise(F.col("_low")),
        "high": F.when(own, F.col("_one.high")).when(single & positive, mid * 1.5).when(single, mid + half).when(narrow, mid * 1.15).otherwise(F.col("_high")),
    }
    told = q.select(by, "n", ends["low"].alias("low"), mid.alias("central"), ends["high"].alias("high"), "_positive", "_mean")
    wide = (F.col("low") > 0) & (F.col("high") / F.col("low") > 10)
    kind = F.when(~F.col("_positive"), "triangular").when(wide, "loguniform").otherwise("lognormal")
    sure = F.round(F.least(F.lit(1.0), F.col("_mean") / 100 * (1 + 0.05 * (F.col("n") - 1))), 3)
    told = told.select(by, "n", "low", "central", "high", kind.alias("distribution"), sure.alias("confidence"))
    return parameters.select(by).distinct().join(told, by, "left").fillna(0, ["n"])
