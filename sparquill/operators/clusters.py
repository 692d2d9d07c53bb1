"""Clusters of evidence and claims that say the same."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import stage
from .graph import components


def alike(a: str, b: str, least: float) -> bool:
    """Whether two texts match by a ratio; the bounds that are cheap to see come first."""
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def _signs(text: Column) -> Column:
    """The characters of a text, each with its number among its like, as code point * 2^32 + number. Two texts share as many of these as they share characters."""
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    times = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.flatten(F.transform(letters, lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda n: F.shiftleft(F.ascii(c).cast("long"), 32) + n)))


@F.arrow_udf(DoubleType())
def _ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """2 * characters in matching blocks / characters of both, block by block from the longest on."""
    return pa.array([SequenceMatcher(None, a, b).ratio() for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


#: Up to so many texts of one group meet by a plain join; more are dealt to tiles of so many.
FEW, TILE = 64, 4096


def _shared(least: float):
    """Pairs of one pair of tiles (side 0 and 1; a tile with itself has side 0 alone) that share enough characters: products of 0/1 rows, one column for each
    character that both hold, in slices of columns."""

    def group(rows: pa.Table) -> pa.Table:
        sides = [rows.filter(pc.equal(rows["_side"], k)) for k in (0, 1)]
        x, y = sides if sides[1].num_rows else (sides[0], sides[0])
        signs = [z["s"].combine_chunks() for z in (x, y)]
        owner = [np.repeat(np.arange(len(z)), np.diff(z.offsets.to_numpy())) for z in signs]
        values = [z.flatten().to_numpy() for z in signs]
        common = np.intersect1d(*values)
        held = [np.isin(v, common) for v in values]
        owner = [o[h] for o, h in zip(owner, held, strict=True)]
        place = [np.searchsorted(common, v[h]) for v, h in zip(values, held, strict=True)]
        product = np.zeros((x.num_rows, y.num_rows), np.float32)
        for start in range(0, len(common), 1024):
            width = min(1024, len(common) - start)
            parts = []
            for o, p in zip(owner, place, strict=True):
                here = (p >= start) & (p < start + width)
                part = np.zeros((x.num_rows if len(parts) == 0 else y.num_rows, width), np.float32)
                part[o[here], p[here] - start] = 1
                parts.append(part)
            product += parts[0] @ parts[1].T
        sizes = [z["n"].to_numpy().astype(np.float32) for z in (x, y)]
        left, right = [], []
        for row in range(0, x.num_rows, 256):
            at, to = np.nonzero(2 * product[row : row + 256] >= (least - 1e-5) * (sizes[0][row : row + 256, None] + sizes[1][None, :]))
            left.append(at + row)
            right.append(to)
        left, right = np.concatenate(left), np.concatenate(right)
        if x is y:
            left, right = left[left < right], right[left < right]
        found = {c: x[c].take(pa.array(left)) for c in rows.column_names if c.startswith("_k")}
        found |= {"t_a": x["t"].take(pa.array(left)), "n_a": x["n"].take(pa.array(left)), "t_b": y["t"].take(pa.array(right)), "n_b": y["n"].take(pa.array(right))}
        return pa.table({**found, "common": pa.array(product[left, right].astype(np.int64))})

    return group


def similar_pairs(rows: DataFrame, by: list[str], text: str, least: float = 0.75) -> DataFrame:
    """(the columns of by, a, b, most): distinct texts a < b of rows that agree in `by` (nulls apart) and share so many characters, `most`, that their
    ratio can be `least`. No pair is missing. Texts of a small group meet by a join on `by`. Those of a large one are dealt to tiles in order of their
    lengths; tiles whose lengths fit meet, and a task compares two of them by products of matrices, so that it holds two tiles whatever the group's size and no
    pair is written but one that is told. Empty texts are like nothing.
    """
    named = [F.col(c).alias(f"_k{k}") for k, c in enumerate(by)]
    keys, fraction = [f"_k{k}" for k in range(len(by))], least / (2 - least)
    own = rows.select(*named, F.col(text).alias("t")).dropna().where("t <> ''").distinct().withColumn("s", _signs(F.col("t"))).withColumn("n", F.size("s"))
    own = stage(own)
    fits = lambda x, y: (F.col(x) >= F.col(y) * fraction - 1e-9) & (F.col(y) >= F.col(x) * fraction - 1e-9)
    lengths = own.groupBy(*keys, "n").agg(F.count("*").alias("_own"))
    within = Window.partitionBy(*keys)
    lengths = lengths.withColumn("_all", F.sum("_own").over(within)).withColumn("_to", F.sum("_own").over(within.orderBy("n")))
    dealt = own.join(lengths, [*keys, "n"])
    place = F.col("_to") - F.col("_own") + F.pmod(F.xxhash64("t"), "_own")
    dealt = stage(dealt.select(*keys, "t", "s", "n", F.when(F.col("_all") > FEW, F.floor(place / TILE).cast("long")).alias("_tile")))
    few = dealt.where(F.col("_tile").isNull())
    a, b = (few.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in ("t", "n", "s"))).hint("merge") for x in "ab")
    pairs = a.join(b, keys).where("t_a < t_b").where(fits("n_a", "n_b"))
    pairs = pairs.select(*keys, "t_a", "n_a", "t_b", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))
    tiles = dealt.where(F.col("_tile").isNotNull()).groupBy(*keys, "_tile").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    x, y = (tiles.select(*keys, *(F.col(c).alias(c + e) for c in ("_tile", "_lo", "_hi"))) for e in "xy")
    meet = x.join(y, keys).where("_tilex <= _tiley").where(F.col("_hix") >= F.col("_loy") * fraction - 1e-9)
    meet = stage(meet.select(*keys, "_tilex", "_tiley"))
    sides = [dealt.withColumnRenamed("_tile", f"_tile{e}").join(meet.where("_tilex < _tiley") if k else meet, [*keys, f"_tile{e}"]).withColumn("_side", F.lit(k)) for k, e in enumerate("xy")]
    both = sides[0].unionByName(sides[1])
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    told = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t_a string, n_a int, t_b string, n_b int, common long"
    tiled = both.groupBy(*keys, "_tilex", "_tiley").applyInArrow(_shared(least), told)
    pairs = pairs.unionByName(tiled.withColumns({c: F.when(F.col("t_a") < F.col("t_b"), F.col(c)).otherwise(F.col(o)) for c, o in (("t_a", "t_b"), ("t_b", "t_a"), ("n_a", "n_b"), ("n_b", "n_a"))}))
    most = F.round(2.0 * F.col("common") / (F.col("n_a") + F.col("n_b")), 9)
    return pairs.withColumn("most", most).where(F.col("most") >= least - 1e-9).select(*(F.col(f"_k{k}").alias(c) for k, c in enumerate(by)), F.col("t_a").alias("a"), F.col("t_b").alias("b"), "most")


def similar_links(rows: DataFrame, id: str, by: list[str], text: str, least: float = 0.75) -> DataFrame:
    """(src, dst, weight) of rows that agree in `by` and whose texts are alike by a ratio of `least`: rows of one text are linked to the least of them, and
    the least rows of two like texts to each other."""
    named = rows.dropna(subset=[*by, text]).where(F.col(text) != "")
    heads = named.groupBy(*by, text).agg(F.min(id).alias("head"))
    copies = named.join(heads, [*by, text]).where(F.col(id) != F.col("head")).select(F.col("head").alias("src"), F.col(id).alias("dst"))
    alike = similar_pairs(rows, by, text, least).where(_ratio("a", "b") >= least)
    near = alike.join(heads.select(*by, F.col(text).alias("a"), F.col("head").alias("src")), [*by, "a"]).join(heads.select(*by, F.col(text).alias("b"), F.col("head").alias("dst")), [*by, "b"])
    return copies.union(near.select("src", "dst")).withColumn("weight", F.lit(1.0))


def evidence_clusters(rows: DataFrame, id: str, parameter: str, keys: list[str], value: list[str], title: str, least: float = 0.75) -> DataFrame:
    """(id, cluster): items of one parameter that are the same source said again: they agree in a key (content, origin), or in all of `value` with titles
    alike by `least`; directly or over others. The cluster is named for its least item. No parameter's items are gathered."""
    within = rows.select(id, *(F.when(F.col(k).cast("string") != "", F.to_json(F.struct(F.col(parameter).alias("p"), F.col(k).alias("k")))).alias(k) for k in keys))
    links = equal_links(within, id, keys).unionByName(similar_links(rows, id, [parameter, *value], title, least))
    found = components(links)
    return rows.select(id).distinct().join(found.withColumnRenamed("node", id), id, "left").select(id, F.coalesce("component", id).alias("cluster"))


def equal_links(rows: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """(src, dst, weight) of rows that agree in any of the keys: each value links its rows to the least of them, so copies make no pairs."""
    out = None
    for key in keys:
        own = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(F.col(id).alias("dst"), F.col(key).alias("k"))
        links = own.join(own.groupBy("k").agg(F.min("dst").alias("src")), "k").where("src <> dst").select("src", "dst")
        out = links if out is None else out.union(links)
    return out.distinct().withColumn("weight", F.lit(1.0))


def reprints(rows: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """(id, cluster): rows that agree in any key, directly or over others; the cluster is named for its least row."""
    found = components(equal_links(rows, id, keys))
    return rows.select(id).distinct().join(found.withColumnRenamed("node", id), id, "left").select(id, F.coalesce("component", id).alias("cluster"))


def greedy_claims(claims: DataFrame, job: str, id: str, key: str, text: str, order: str, least: float = 0.75) -> DataFrame:
    """(job, id, cluster): in order, a claim joins the first cluster of its key, or without a key the first that has a similar member; else it opens one.
    The order decides, so a job's claims, which one report holds, are read together."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        members: list[list[str]] = []
        by_key: dict = {}
        out = []
        for k, t in zip(pdf[key], pdf[text], strict=True):
            if k:
                place = by_key.get(k)
            else:
                place = next((n for n, own in enumerate(members) if any(alike(t, o, least) for o in own)), None)
            if place is None:
                place = len(members)
                members.append([])
                if k:
                    by_key[k] = place
            if not k:
                members[place].append(t)
            out.append(place)
        return pd.DataFrame({job: pdf[job].to_numpy(), id: pdf[id].to_numpy(), "cluster": out})

    kinds = {f.name: f.dataType.simpleString() for f in claims.schema}
    return claims.groupBy(job).applyInPandas(group, f"{job} {kinds[job]}, {id} {kinds[id]}, cluster int")
