"""Checks, roll-ups and listings over runs, claims, evidence, models and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top

# Weights of a model's criteria.
MODEL = {"estimability": 0.20, "unit_consistency": 0.20, "explainability": 0.15, "evidence_availability": 0.20, "double_counting_risk": 0.10, "dependency_risk": 0.05, "independence": 0.10}
# Hosts of social networks, and parts of the labels of others.
SOCIAL = ["twitter.com", "x.com", "facebook.com", "reddit.com", "note.com"]
SOCIAL_LABELS = r"5ch|blog|bbs|forum|ameblo|hatenablog|livedoor"
# Words of questions that a table answers, and of texts that revise another.
TABLE_WORDS = "合計|平均|最大|最小|件数|何件|割合|比率|率|上位|ランキング|sum|average|mean|count|total|max|min|より大き|より小さ|以上|以下|集計|計算"
REVISED = "訂正|撤回|改訂|修正版|revised|correction|retraction"
NATIONWIDE = ["日本", "全国", "国内"]


def critiques(parameters: DataFrame, evidence: DataFrame, reference: int, stale: int = 8) -> DataFrame:
    """(parameter, issue, severity) of a parameter's accepted evidence, by rule: none at all; a single source; copies of one; another region (or the whole
    country's value); old data; conflicts of interest; no method told; a biased sample; a wide range; a mean for a median; parameters that depend.

    parameters: id, central, low, high, geography, definition, correlated. evidence: parameter, cluster, score, geography, year, conflict, biased,
    method, excerpt. Everything is aggregated by parameter once.
    """
    p = parameters.alias("p")
    rows = evidence.join(p, F.col("parameter") == F.col("p.id"))
    wanted, own = F.col("p.geography"), evidence["geography"]
    other = (F.coalesce(own, F.lit("")) != "") & (F.coalesce(wanted, F.lit("")) != "") & ~F.contains(own, wanted)
    sums = rows.groupBy("parameter").agg(
        F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"), F.max(F.coalesce("score", F.lit(0.0))).alias("best"), F.count_if(other).alias("elsewhere"),
        F.count_if(other & own.isin(*NATIONWIDE)).alias("nationwide"), F.count_if(F.lit(reference) - F.col("year") > stale).alias("stale"), F.count_if("conflict").alias("conflicts"),
        F.count_if("biased").alias("biased"), F.count_if(F.coalesce("method", F.lit("")) != "").alias("methods"), F.count_if(F.contains("excerpt", F.lit("平均"))).alias("means"),
    )
    joined = parameters.join(sums, parameters.id == sums.parameter, "left").drop("parameter")
    n = F.coalesce("n", F.lit(0))
    none = F.col("central").isNull() & (n == 0)
    rules = [
        ("no_evidence", none, F.lit(0.9)),
        ("single_source", F.col("clusters") == 1, F.when(F.col("best") < 75, 0.6).otherwise(0.45)),
        ("duplicate_primary_source", F.col("n") > F.col("clusters"), F.lit(0.35)),
        ("geography_mismatch", F.col("elsewhere") > 0, F.when(F.col("nationwide") > 0, 0.5).otherwise(0.65)),
        ("stale_extrapolation", F.col("stale") > 0, F.lit(0.55)),
        ("conflict_of_interest", F.col("conflicts") > 0, F.lit(0.5)),
        ("opaque_methodology", (n > 0) & (F.col("methods") == 0), F.lit(0.5)),
        ("sample_bias", F.col("biased") > 0, F.lit(0.45)),
        ("wide_uncertainty", (F.col("low") > 0) & (F.col("high") / F.col("low") > 5), F.lit(0.5)),
        ("mean_median_confusion", (F.col("means") > 0) & F.col("definition").rlike("中央値|median"), F.lit(0.4)),
        ("correlated_parameters", F.col("correlated"), F.lit(0.3)),
    ]
    hold = F.array(*(F.when((cond if name == "no_evidence" else cond & ~none), F.struct(F.lit(name).alias("issue"), severity.alias("severity"))) for name, cond, severity in rules))
    return joined.select(F.col("id").alias("parameter"), F.explode(F.filter(hold, lambda x: x.isNotNull())).alias("c")).select("parameter", "c.*")


def counter_evidence(parameters: DataFrame, found: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(parameter, id, issue, severity) of evidence against a parameter (parameter, id, value in its unit, score, text): a text that revises, and a value
    that differs by more than a factor, weighed by the evidence's score."""
    rows = found.join(parameters.select(F.col("id").alias("parameter"), "central"), "parameter")
    apart = F.greatest("value", "central") / F.least("value", "central")
    scale = F.least(F.lit(1.0), F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(30.0)) / 60)
    revised = F.when(F.coalesce("text", F.lit("")).rlike(REVISED), F.struct(F.lit("retraction_or_revision").alias("issue"), F.lit(0.6).alias("severity")))
    against = F.when((F.col("value") > 0) & (F.col("central") > 0) & (apart > ratio), F.struct(F.lit("counter_evidence_exists").alias("issue"), F.round(F.least(0.3 + 0.1 * apart, F.lit(0.8)) * scale, 2).alias("severity")))
    return rows.select("parameter", "id", F.explode(F.filter(F.array(revised, against), lambda x: x.isNotNull())).alias("c")).select("parameter", "id", "c.*")


def confidence(parameters: DataFrame, by: str, own: str, central: str, severe: str, agreement: str) -> DataFrame:
    """(by, confidence): the mean of the parameters' confidence (0.2 without any), less 0.2 if a value is missing, less 0.05 for each severe open
    critique up to 0.2, and 0.05 more or 0.15 less as a second model agrees or not (it doesn't if any row says so); within 0.05 and 0.95."""
    sums = parameters.groupBy(by).agg(F.avg(own).alias("m"), F.count_if(F.col(central).isNull()).alias("missing"), F.sum(severe).alias("severe"), F.max(F.when(F.col(agreement).isin("consistent", "discrepant"), F.col(agreement))).alias("agreement"))
    check = F.when(F.col("agreement") == "consistent", 0.05).when(F.col("agreement") == "discrepant", -0.15).otherwise(0.0)
    base = F.coalesce("m", F.lit(0.2)) - F.when(F.col("missing") > 0, 0.2).otherwise(0.0) - F.least(0.05 * F.col("severe"), F.lit(0.2)) + check
    return sums.select(by, F.round(F.least(F.greatest(base, F.lit(0.05)), F.lit(0.95)) + 1e-9, 2).alias("confidence"))


def model_scores(models: DataFrame, by: list[str], id: str) -> DataFrame:
    """Adds score (the criteria's weighted sum, to three places) and use: primary for the best of a project, check for the next, else other."""
    scored = models.withColumn("score", F.round(sum((F.lit(w) * F.col(c) for c, w in MODEL.items()), F.lit(0.0)) + 1e-9, 3))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(id)))
    return scored.withColumn("use", F.when(place == 1, "primary").when(place == 2, "check").otherwise("other"))


def within_budget(queries: DataFrame, by: str, order: str, cost: str, most: int, budget: float) -> DataFrame:
    """Adds spent (cost up to and with the query) and fits: neither the number of searches nor the cost is over its limit yet."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = queries.withColumn("spent", F.sum(cost).over(upto)).withColumn("_k", F.count("*").over(upto))
    return rows.withColumn("fits", (F.col("_k") <= most) & (F.col("spent") <= budget)).drop("_k")


def run_metrics(events: DataFrame, run: str, order: str, kind: str, fields: list[str]) -> DataFrame:
    """(run, the last known value of each field, searches, sources)."""
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(run).agg(*last, F.count_if(F.col(kind) == "search").alias("searches"), F.count_if(F.col(kind) == "source_found").alias("sources"))


def social_host(host: Column) -> Column:
    """Whether a host is a social network's, one below it, or has a blog's or forum's label."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", "")
    own = F.exists(F.array(*map(F.lit, SOCIAL)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))
    return (h != "") & (own | h.rlike(SOCIAL_LABELS))


def table_route(question: Column) -> Column:
    """table for questions that count or compare, else rag."""
    return F.when(F.lower(question).rlike(TABLE_WORDS), "table").otherwise("rag")


def unverified(publisher: Column, host: Column, primary_host: Column, claims: str, trusted: list[str]) -> Column:
    """Whether a publisher whose name claims authority (a pattern) has neither a trusted host nor a primary source on one."""
    known = lambda h: F.exists(F.array(*map(F.lit, trusted)), lambda d: F.endswith(F.coalesce(h, F.lit("")), d))
    return F.coalesce(publisher, F.lit("")).rlike(claims) & ~known(host) & ~known(primary_host)


def succeeded(claims: DataFrame, runs: DataFrame, run: str, status: str, good: str) -> DataFrame:
    """Claims of runs that succeeded, with the runs' columns."""
    return claims.join(runs.where(F.col(status) == good), run)


def with_sources(evidence: DataFrame, sources: DataFrame, url: str, title: str) -> DataFrame:
    """(url, title, from_evidence): the sources, and one for each other url that evidence names."""
    missing = evidence.where(F.coalesce(F.col(url), F.lit("")) != "").select(url).distinct().join(sources, url, "left_anti")
    return sources.select(url, title, F.lit(False).alias("from_evidence")).unionByName(missing.select(url, F.lit(None).cast("string").alias(title), F.lit(True).alias("from_evidence")))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an array of their children, in order; without children it is empty. For children that one view shows: a claim's evidence, a job's runs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_c"))))
    lists = children.groupBy(key).agg(F.transform(rows, lambda r: r["_c"]).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def shared_evidence(uses: DataFrame, model: str, item: str, cluster: str, cls: str, weak: list[str]) -> DataFrame:
    """(a, b, items, clusters, weak): of pairs of models, evidence and clusters that both use, and how many of the shared items are of a weak class.
    Models are few (a project's candidates); each meets an item and a cluster once, however many uses there are."""
    items = uses.groupBy(model, item).agg(F.coalesce(F.max(F.col(cls).isin(*weak)), F.lit(False)).alias("weak"))

    def pairs(rows: DataFrame, key: str, *more: Column) -> DataFrame:
        met = rows.alias("l").join(rows.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"l.{model}") < F.col(f"r.{model}")))
        return met.groupBy(F.col(f"l.{model}").alias("a"), F.col(f"r.{model}").alias("b")).agg(F.count("*").alias(f"{key}s"), *more)

    found = pairs(items, item, F.count_if("l.weak").alias("weak")).join(pairs(uses.select(model, cluster).distinct(), cluster), ["a", "b"], "full_outer")
    return found.na.fill(0)


def status_counts(rows: DataFrame, by: str, status: str, names: list[str]) -> DataFrame:
    """(by, n, a count for each status, coverage): coverage is the share of the first status."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col(status) == s).alias(s) for s in names))
    return sums.withColumn("coverage", F.col(names[0]) / F.col("n"))


def body_size(spans: DataFrame, doc: str, size: str, text: str) -> DataFrame:
    """(doc, size): the font size that most characters have, the least on a tie."""
    sums = spans.groupBy(doc, size).agg(F.sum(F.length(text)).alias("chars"))
    return sums.groupBy(doc).agg(F.min_by(size, F.struct(-F.col("chars"), size)).alias(size))


def front_wins(front: DataFrame, candidate: str, chapter: str, score: str) -> DataFrame:
    """(candidate, wins, agg): chapters in which a candidate of the front is best (or equal to it), and its mean score."""
    best = F.max(score).over(Window.partitionBy(chapter))
    return front.withColumn("_won", F.col(score) >= best - 1e-9).groupBy(candidate).agg(F.count_if("_won").alias("wins"), F.avg(score).alias("agg"))


def next_parent(ranked: DataFrame, order: list[Column], turn: int) -> DataFrame:
    """The candidate whose turn it is, in rotation through the ranking. A front is a small table."""
    rows = ranked.withColumn("_k", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return rows.where(F.col("_k") == F.lit(turn) % F.col("_n")).drop("_k", "_n")


def after_cursor(events: DataFrame, job: str, seq: str, cursors: DataFrame, most: int = 500) -> DataFrame:
    """Each job's next events after its cursor (job, after), in order, at most so many."""
    newer = events.join(cursors, job).where(F.col(seq) > F.col("after")).drop("after")
    return top(newer, [job], [F.asc(seq)], most).drop("rank")


def latest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def decomposition_checks(proposals: DataFrame, id: str, expression: str, children: str, known: str, leaves: str, most: int = 15) -> DataFrame:
    """(id, has_expression, no_cycle, expression_valid, within_leaf_limit, observable, few_children) of proposed decompositions: children is an array of
    struct(id, terms); known are the ids that exist; names in the expression must be children."""
    ids = F.transform(children, lambda c: c["id"])
    clash = F.exists(ids, lambda c: (c == F.col(id)) | (F.array_contains(known, c) & ~F.startswith(c, F.col(id))))
    names = F.regexp_extract_all(F.col(expression), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return proposals.select(
        id, (F.trim(expression) != "").alias("has_expression"), (~clash).alias("no_cycle"), ((F.trim(expression) != "") & (F.size(F.array_except(names, ids)) == 0)).alias("expression_valid"),
        (F.col(leaves) - 1 + F.size(children) <= most).alias("within_leaf_limit"), F.forall(children, lambda c: F.size(c["terms"]) > 0).alias("observable"), (F.size(children) <= 4).alias("few_children"),
    )


def to_decompose(parameters: DataFrame, severity: str, importance: str, depth: str) -> DataFrame:
    """Parameters that are worth taking apart: a severe critique on one that matters, not too deep."""
    return parameters.where((F.col(severity) >= 0.6) & (F.col(importance) >= 0.4) & (F.col(depth) < 3))


def annual_capacity(parameters: DataFrame, id: str, unit: str) -> DataFrame:
    """(id, expression, children: array of struct(id, unit)) for rates by year such as x/(y*year): a daily rate times working days."""
    pattern = r"^([A-Za-z_]+)/\(([A-Za-z_]+)\*year\)$"
    u = F.regexp_replace(F.col(unit), " ", "")
    daily, days = F.concat(F.col(id), F.lit("_daily")), F.concat(F.col(id), F.lit("_working_days"))
    children = F.array(F.struct(daily.alias("id"), F.concat(F.regexp_extract(u, pattern, 1), F.lit("/("), F.regexp_extract(u, pattern, 2), F.lit("*day)")).alias("unit")), F.struct(days.alias("id"), F.lit("day/year").alias("unit")))
    return parameters.where(u.rlike(pattern)).select(id, F.concat(daily, F.lit(" * "), days).alias("expression"), children.alias("children"))
