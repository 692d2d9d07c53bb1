"""Mixing sources to target weights by cube-method balanced sampling.

Targets share a budget by weight, stop at a cap and pass the excess on (water filling over one row per source). A document is taken whole as often as
its source's rate says; the fraction that is left is an inclusion probability. The flight moves these through the null space of the two balancing
constraints, documents and tokens of the source, until they are 0 or 1. It runs in groups of about `GROUP` documents, each of which leaves two
fractions at most; these meet in the next level's groups until a source has one group, whose two fractions are the landing problem: the roundings
nearest to the token total are taken. Nothing larger than a group is held in a task, and a source of any size is spread over its groups.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take no words; groups, order and
random numbers come from hashes of id, source and text alone, so reruns agree however the files are laid out; rows that are equal in all three are
drawn one by one, and of those it is the number taken that is defined; other columns are left alone.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered
from .common import free, keep, placed

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
GROUP, SEED, TINY = 1000, 42, 1e-9


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, _total, _n, _target) from rows (_source, _size).

    Sources are numbered by a range sort, as they may be as many as hosts. The water level rises until no source is above its cap: each step adds up
    what the sources full at the last level leave to the others, and stops when no further source is full.
    """
    own = keep(sizes.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count("*").alias("_n")), "sources")
    own = numbered(own.withColumn("_last", F.col("_source").isNull()), ["_last", "_source"], "_place")
    own = own.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("double"))
    own = keep(own.withColumn("top", F.col("_total") * F.lit(float(cap))), "weighed")
    budget, level, before = own.agg(F.coalesce(F.sum("_total"), F.lit(0)) * F.lit(float(share))).first()[0], 0.0, None
    while True:
        full = F.col("top") <= F.col("w") * level
        used, open_, n = own.agg(F.sum(F.when(full, F.col("top")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count(F.when(full, 1))).first()
        if n == before or not open_:
            break
        before, level = n, (budget - used) / open_
    return own.select("_source", "_total", "_n", F.when(full, F.col("top")).otherwise(F.col("w") * level).alias("_target"))


def flight(p: np.ndarray, size: np.ndarray, chance, land: bool) -> np.ndarray:
    """Move fractions p to 0 or 1 while sum(p) and sum(p * size) stay; two may be left, and none if land."""
    p, active, waiting = p.astype(float).tolist(), [], iter(np.flatnonzero((p > 0) & (p < 1)).tolist())
    s = size.astype(float).tolist()
    while True:
        while len(active) < 3 and (k := next(waiting, None)) is not None:
            active.append(k)
        if len(active) < 3 and not (len(active) == 2 and s[active[0]] == s[active[1]]):
            break
        if len(active) == 3:
            i, j, k = active
            u = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
            u = u if any(u) else (1.0, -1.0, 0.0)
        else:
            u = (1.0, -1.0)
        up = min(((1 - p[a]) / x if x > 0 else p[a] / -x) for a, x in zip(active, u, strict=True) if x)
        down = min((p[a] / x if x > 0 else (1 - p[a]) / -x) for a, x in zip(active, u, strict=True) if x)
        step = up if chance() * (up + down) < down else -down
        for a, x in zip(active, u, strict=True):
            v = p[a] + step * x
            p[a] = 0.0 if v < TINY else 1.0 if v > 1 - TINY else v
        active = [a for a in active if 0 < p[a] < 1]
    if land and active:
        wanted = sum(p[a] * s[a] for a in active)
        ends = min(product((0.0, 1.0), repeat=len(active)), key=lambda e: (abs(sum(x * s[a] for x, a in zip(e, active, strict=True)) - wanted), e))
        for a, x in zip(active, ends, strict=True):
            p[a] = x
    return np.array(p)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_size", "_order"], ascending=[False, True]).reset_index(drop=True)  # equal rows are alike in all that counts
    state = [0]
    seed = f"{pdf['_group'].iat[0]}:{len(pdf)}:{int(pdf['_order'].iat[0])}".encode()

    def chance() -> float:
        state[0] += 1
        return (xxhash.xxh64_intdigest(seed + str(state[0]).encode(), SEED) >> 11) / 2**53

    return pdf.assign(_p=flight(pdf["_p"].to_numpy(), pdf["_size"].to_numpy(), chance, bool(pdf["_last"].iat[0])))


def _salted(rows: DataFrame) -> DataFrame:
    """Adds _salt, which cuts more than `GROUP` equal rows into runs of about that many, and is 0 elsewhere. Runs follow the total order of these rows,
    in which equal rows stand together, so where a run ends doesn't depend on the rows' places."""
    many = keep(rows.groupBy("_order").agg(F.count("*").alias("_times")).where(F.col("_times") > GROUP).select("_order"), "many")
    if not many.take(1):
        return rows.withColumn("_salt", F.lit(0).cast("long"))
    few = many.count() <= 100_000
    many = F.broadcast(many) if few else many
    dealt = numbered(rows.join(many, "_order", "left_semi"), ["_order", "_place"], "_salt").withColumn("_salt", F.floor(F.col("_salt") / GROUP) + 1)
    return rows.join(many, "_order", "left_anti").withColumn("_salt", F.lit(0).cast("long")).unionByName(dealt.select(*rows.columns, "_salt"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, columns: tuple[str, ...] = (), place: str = "") -> DataFrame:
    """Rows (_row: struct of `columns`; _place: the row's number, which column `place` of docs holds or `placed` gives; _size, _source_size, _target, _taken: words that the mix
    takes, a whole multiple of _size). Texts stay behind: only keys and sizes are shuffled and flown."""
    if not place:
        place = free(docs.columns, "_place")
        docs = placed(docs, place)
    same = F.xxhash64(docs[id].cast("string"), docs[source].cast("string"), docs[text])
    carried = F.struct(*(docs[c].alias(c) for c in columns)) if columns else F.struct(F.lit(None).cast("string").alias("_none"))
    rows = keep(docs.select(carried.alias("_row"), docs[place].alias("_place"), docs[source].cast("string").alias("_source"), words(docs[text]).alias("_size"), same.alias("_order")), "sizes")
    shares = keep(targets(rows.select("_source", "_size"), weights, share, cap), "targets")
    rows = rows.join(shares.withColumnRenamed("_source", "_key"), F.col("_source").eqNullSafe(F.col("_key")), "left").drop("_key")
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < TINY, F.round(rate)).otherwise(rate)
    whole = F.floor(rate)
    rows = rows.withColumn("_p", F.when(F.col("_size") > 0, rate - whole).otherwise(0.0)).withColumn("_whole", whole)
    rows, groups = _salted(rows), F.ceil(F.col("_n") / GROUP)
    done, level, fixed = None, 0, ["_row", "_place", "_source", "_size", "_order", "_salt", "_total", "_target", "_whole", "_p"]
    while True:
        dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_order", "_salt", F.lit(level)), groups)).withColumn("_last", groups <= 1).drop("_n")
        flown = keep(dealt.groupBy("_source", "_group").applyInPandas(_fly, dealt.schema), f"mix{level}").select(fixed)
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done = flown.where(~open_) if done is None else done.union(flown.where(~open_))
        left = flown.where(open_)
        if not left.take(1):
            break
        counts = left.groupBy("_source").agg(F.count("*").alias("_n")).withColumnRenamed("_source", "_key")
        rows, level = left.join(counts, F.col("_source").eqNullSafe(F.col("_key"))).drop("_key"), level + 1
    return done.select("_row", "_place", "_size", F.col("_total").alias("_source_size"), "_target", ((F.col("_whole") + F.col("_p")) * F.col("_size")).cast("long").alias("_taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Options as for `mix`."""
    place, again = free(docs.columns, "_place"), free(docs.columns, "_again")
    rows = placed(docs, place)
    drawn = mix(rows, place=place, **options)
    times = F.when(drawn["_size"] > 0, (drawn["_taken"] / drawn["_size"]).cast("int")).otherwise(0)
    counts = drawn.where(times > 0).select(F.col("_place").alias(place), F.sequence(F.lit(1), times).alias(again))
    # the same join at every size: the counts have a row for each document that is taken
    return rows.join(counts.hint("merge"), place).withColumn(again, F.explode(again)).select(*(f"`{c}`" for c in docs.columns))
