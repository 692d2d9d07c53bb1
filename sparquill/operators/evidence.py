"""Evidence and claims: scores, clusters, contradictions, comparison across engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.tables import numbered, stage

# Weights of sub-scores and penalties.
WEIGHTS = {"source_authority": 0.18, "primaryness": 0.14, "parameter_directness": 0.18, "methodology_transparency": 0.12, "geography_fit": 0.08, "population_fit": 0.07, "time_fit": 0.08, "recency": 0.05, "independence": 0.05, "reproducibility": 0.05}
PENALTIES = {"conflict_of_interest": 15.0, "unclear_definition": 10.0, "secondary_citation": 12.0, "stale_data": 10.0, "sample_bias": 10.0, "unverifiable_claim": 15.0}
AUTHORITY = {"S": 95.0, "A": 85.0, "B": 70.0, "C": 50.0, "D": 40.0, "E": 20.0}


def subscores(cls: Column, copied: Column, value: Column, definition: Column, method: Column, geography: Column, wanted: Column, year: Column, reference: int, located: Column) -> dict[str, Column]:
    """The sub-scores of evidence from what is known of it; booleans say that something is there."""
    authority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in AUTHORITY.items() for x in p)), cls), F.lit(30.0))
    top = cls.isin("S", "A")
    return {
        "source_authority": authority,
        "primaryness": F.when(copied, 30.0).when(top, 92.0).when(cls == "B", 75.0).otherwise(45.0),
        "parameter_directness": F.when(value & definition, 88.0).when(value, 75.0).otherwise(50.0),
        "methodology_transparency": F.when(method, 85.0).otherwise(25.0),
        "geography_fit": numbers.geography_fit(geography, wanted),
        "population_fit": F.lit(55.0),
        "time_fit": F.when(year.isNull(), 35.0).otherwise(numbers.time_fit(F.abs(F.lit(reference) - year))),
        "recency": F.when(year.isNull(), 35.0).otherwise(numbers.recency(F.lit(reference) - year)),
        "independence": F.when(copied, 30.0).otherwise(85.0),
        "reproducibility": F.when(top | (located & method), 85.0).when(located, 60.0).otherwise(35.0),
    }


def total(scores: dict[str, Column], penalties: dict[str, Column]) -> Column:
    """The weighted sum less the penalties that hold, within 0 and 100."""
    good = sum((WEIGHTS[k] * v for k, v in scores.items()), F.lit(0.0))
    bad = sum((F.when(v, PENALTIES[k]).otherwise(0.0) for k, v in penalties.items()), F.lit(0.0))
    return F.least(F.greatest(good - bad, F.lit(0.0)), F.lit(100.0))


def representatives(rows: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score in each cluster, the first on a tie."""
    rest = F.struct(*(c for c in rows.columns if c not in by))
    return rows.groupBy(*by).agg(F.min_by(rest, F.struct(-F.col(score), F.col(order))).alias("r")).select(*by, "r.*")


def contradictions(reps: DataFrame, by: str, id: str, value: str, ratio: float = 2.0) -> DataFrame:
    """(by, a, b, ratio): pairs of positive representatives of a parameter whose values differ by more than a factor.

    Values are dealt to bands by powers of the factor. Partners are in different bands, so a pair is found where its two bands meet: the join is on
    the group and both bands, which spreads a large group over as many tasks as it has pairs of bands.
    """
    band = F.floor(F.log(F.col(value).cast("double")) / F.log(F.lit(float(ratio)))).cast("int")
    rows = reps.where(F.col(value) > 0).select(F.col(by).alias("by"), F.col(id).alias("id"), F.col(value).alias("v"), band.alias("band"))
    rows = rows.join(rows.groupBy("by").agg(F.collect_set("band").alias("bands")), "by")
    high = rows.select("by", F.col("id").alias("p"), F.col("v").alias("x"), F.col("band").alias("upper"), F.explode(F.filter("bands", lambda k: k < F.col("band"))).alias("lower"))
    low = rows.select("by", F.col("id").alias("q"), F.col("v").alias("y"), F.explode(F.filter("bands", lambda k: k > F.col("band"))).alias("upper"), F.col("band").alias("lower"))
    found = high.join(low, ["by", "upper", "lower"]).where(F.col("x") > ratio * F.col("y"))
    return found.select(F.col("by").alias(by), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (F.col("x") / F.col("y")).alias("ratio"))


def compare(claims: DataFrame, cluster: str, engine: str, value: str, evidence: str, engines: int) -> DataFrame:
    """(cluster, engines, values, evidence, verdict): conflict if values differ, agreement if all engines (more than one) say it, partial if some do,
    unsupported without evidence. Values are never voted away."""
    found = claims.groupBy(cluster).agg(F.countDistinct(engine).alias("engines"), F.countDistinct(value).alias("values"), F.sum(evidence).alias("evidence"))
    verdict = F.when(F.col("values") > 1, "conflict").when(F.col("evidence") == 0, "unsupported").when((F.col("engines") == engines) & (F.col("engines") > 1), "agreement").otherwise("partial")
    return found.withColumn("verdict", verdict)


def coverage(sources: DataFrame, key: str, engine: str) -> DataFrame:
    """(engine, sources, only_here, shared_by_all) over distinct sources."""
    n = sources.select(engine).distinct().count()
    sets = sources.groupBy(key).agg(F.collect_set(engine).alias("own"))
    return sets.select(F.explode("own").alias(engine), F.size("own").alias("k")).groupBy(engine).agg(F.count("*").alias("sources"), F.count_if(F.col("k") == 1).alias("only_here"), F.count_if(F.col("k") == n).alias("shared_by_all"))


def registry(sources: DataFrame, key: str, engine: str) -> DataFrame:
    """(name, key, engines): S1, S2 and so on in order of the key, with the engines that cite it."""
    sets = sources.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(engine)), ",").alias("engines"))
    return numbered(sets, [key], "_k").select(F.concat(F.lit("S"), "_k").alias("name"), key, "engines")


def skyline(points: DataFrame, a: str, b: str) -> DataFrame:
    """Points that no other is at least as good as in both and better in one (larger is better). Equal points stay together.

    The best b for each a is pre-aggregated and dealt to ranges of a; the best b of all higher ranges (one row for each range) and the running best
    within the range say what is dominated, so that a front as large as its table is spread as well.
    """
    best = points.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.max(b).alias(b))
    placed = stage(best.repartitionByRange(F.desc(a)).withColumn("_range", F.spark_partition_id()))
    higher = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("_range").agg(F.max(b).alias("_best")).select("_range", F.max("_best").over(higher).alias("_best"))
    inside = Window.partitionBy("_range").orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)
    front = placed.withColumn("_own", F.max(b).over(inside)).join(F.broadcast(tops), "_range")
    top = F.greatest("_best", "_own")
    return points.join(front.where(top.isNull() | (F.col(b) > top)).select(a, b), [a, b], "left_semi")


def merge_entities(mentions: DataFrame, key: str, name: str, kind: str, description: str, order: str) -> DataFrame:
    """(key, name, kind, description, n): the commonest name and kind (the first on a tie), the first four different descriptions."""

    def commonest(c: str, out: str) -> DataFrame:
        counts = mentions.groupBy(key, c).agg(F.count("*").alias("k"), F.min(order).alias("first"))
        return counts.groupBy(key).agg(F.min_by(c, F.struct(-F.col("k"), F.col("first"))).alias(out))

    texts = mentions.where(F.col(description) != "").groupBy(key, description).agg(F.min(order).alias("first"))
    ranked = texts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("first"))).where("n <= 4")
    joined = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", description))).alias("d")).select(key, F.substring(F.array_join(F.transform("d", lambda x: x[description]), " / "), 1, 600).alias("description"))
    return mentions.groupBy(key).agg(F.count("*").alias("n")).join(commonest(name, "name"), key).join(commonest(kind, "kind"), key).join(joined, key, "left")


def merge_relations(rows: DataFrame, a: str, b: str, strength: str, order: str) -> DataFrame:
    """(source, target, strength, n): one row for each unordered pair, in the direction of the first, with the greatest strength."""
    first = F.min_by(F.struct(F.col(a).alias("source"), F.col(b).alias("target")), order).alias("r")
    return rows.groupBy(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).agg(first, F.max(strength).alias("strength"), F.count("*").alias("n")).select("r.*", "strength", "n")


def front(points: DataFrame, axes: list[str], tolerance: float = 1e-9, cells: int = 1024) -> DataFrame:
    """Points that no other dominates over any number of axes (larger is better): at least as good in all, less the tolerance, and better by more than it in
    one. Equal points stay together; a point with a null or NaN in an axis isn't in the front and dominates none.

    Quantiles cut the first ten axes into at most `cells` cells. The best point by sum of each cell is broadcast (at most `cells` rows) and drops what is no
    better than it in any axis and worse by more than the tolerance in one; such a point dominates nothing that its better doesn't. Of the others only cells
    meet whose bounds allow it, and only whether a dominating point exists is asked, so anti-correlated points, which are all in the front, are spread.
    """
    known = reduce(lambda x, y: x & y, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in axes])
    values = stage(points.where(known).select(*(F.col(a).cast("double").alias(f"_{i}") for i, a in enumerate(axes))).distinct())
    names = values.columns
    gridded = names[:10]
    cuts = max(1, int(cells ** (1 / len(gridded)) + 1e-9) - 1)
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    at = values.agg(*(F.percentile_approx(c, shares, 1000).alias(c) for c in gridded)).first()
    step = lambda c: sum((F.when(F.col(c) >= v, 1).otherwise(0) for v in at[c] or []), F.lit(0))
    placed = values.withColumn("_cell", F.concat_ws(",", *(step(c).cast("string") for c in gridded)))

    every = lambda f: reduce(lambda x, y: x & y, map(f, names))
    some = lambda f: reduce(lambda x, y: x | y, map(f, names))
    of = lambda side, c: F.col(f"{side}.{c}")
    better = some(lambda c: of("a", c) > of("b", c) + tolerance)
    total = reduce(lambda x, y: x + y, map(F.col, names))
    tops = placed.groupBy("_cell").agg(F.max_by(F.struct(*names), F.struct(total, *names)).alias("t")).select("t.*")
    kept = stage(placed.alias("b").join(F.broadcast(tops.alias("a")), every(lambda c: of("a", c) >= of("b", c)) & better, "left_anti"))
    bounds = kept.groupBy("_cell").agg(*(f(c).alias(f"{c}{n}") for c in names for f, n in ((F.max, "high"), (F.min, "low"))))
    may = every(lambda c: of("a", f"{c}high") >= of("b", f"{c}low") - tolerance) & some(lambda c: of("a", f"{c}high") > of("b", f"{c}low") + tolerance)
    meets = stage(F.broadcast(bounds.alias("a")).join(bounds.alias("b"), may).select(of("a", "_cell").alias("_by"), of("b", "_cell").alias("_cell")))
    asked = kept.join(meets, "_cell").alias("b")
    beaten = asked.join(kept.alias("a"), (F.col("b._by") == F.col("a._cell")) & every(lambda c: of("a", c) >= of("b", c) - tolerance) & better, "left_semi")
    found = kept.select(*names).join(beaten.select(*names).distinct(), names, "left_anti")
    keyed = points.where(known).withColumns({f"_{i}": F.col(a).cast("double") for i, a in enumerate(axes)})
    return keyed.join(found, names, "left_semi").select(*points.columns)
