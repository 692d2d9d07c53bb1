"""Graphs as edge tables: degrees, neighbourhoods, communities, components and personalised PageRank."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered, stage, stage_path


def undirected(edges: DataFrame, a: str = "src", b: str = "dst", weight: str | None = None) -> DataFrame:
    """(src, dst, weight): one row for each unordered pair, weights summed, loops left out."""
    w = F.col(weight) if weight else F.lit(1.0)
    return edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.sum(w).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): the number of edges that end at each node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_nodes(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), F.asc("node")).limit(k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hops): the fewest hops from each seed, up to a limit; seeds have 0."""
    steps = both_ways(edges).select("src", "dst")
    found = front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        front = front.join(steps, front.node == steps.src).select("seed", F.col("dst").alias("node"), F.lit(k).alias("hops")).distinct()
        found = found.union(front).groupBy("seed", "node").agg(F.min("hops").alias("hops"))
        front = found.where(F.col("hops") == k)
    return found


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node that can be reached. Least labels spread over edges, and each round also follows the label's own label."""
    steps = stage(both_ways(edges).select("src", "dst"))
    labels = stage(steps.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "node"))
    for _ in range(rounds):
        near = steps.join(labels, steps.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.src).select("node", F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = stage(step.join(jump, step.label == jump.via).select("node", F.least("label", "far").alias("label"), F.col("label").alias("was")))
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels still change")


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by label propagation: each node takes the heaviest label of its neighbours, the least on a tie, until nothing moves or the
    rounds are over.

    A round moves one half of the nodes (by a digest of their name and the round), then the other, each from what the last step wrote: so neighbours can't
    swap labels for ever, and no component is gathered in a task.
    """
    steps = stage(both_ways(edges))
    labels = stage(steps.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for k in range(rounds):
        moved, first = 0, F.md5(F.concat(F.col("src").cast("string"), F.lit(f"/{k}"))) < "8"
        for half in (first, ~first):
            near = steps.where(half).join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
            best = near.groupBy("src").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("best"))
            after = stage(labels.join(best, labels.node == best.src, "left").select("node", F.coalesce("best", "label").alias("label"), (F.col("best") != F.col("label")).alias("moved")))
            moved += after.where("moved").count()
            labels = after.select("node", "label")
        if not moved:
            break
    return labels.withColumnRenamed("label", "community")


def community_order(members: DataFrame) -> DataFrame:
    """(community, size, name): the largest first, then the least member; named C1, C2 and so on."""
    sizes = members.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    return numbered(sizes.withColumn("_less", -F.col("size")), ["_less", "least"], "_k").select("community", "size", F.concat(F.lit("C"), "_k").alias("name"))


#: Nodes of one block of the rank vector and links of one row of the matrix, at most; buckets of the matrix, at most, each of a million links or more.
NODES, LINKS, BUCKETS = 131_072, 1_000_000, 64
VECTOR = "b int, rank binary, p binary, out binary, share binary, lost double, change double"


def _vector(b: int, rank: np.ndarray, p: np.ndarray, out: np.ndarray, change: float) -> dict:
    share = np.divide(rank, out, out=np.zeros(len(rank)), where=out > 0)
    return {"b": b, "rank": rank.tobytes(), "p": p.tobytes(), "out": out.tobytes(), "share": share.tobytes(), "lost": float(rank[out == 0].sum()), "change": change}


def _vectors(rows: list[dict]) -> pa.Table:
    kinds = [("b", pa.int32()), *((c, pa.binary()) for c in ("rank", "p", "out", "share")), ("lost", pa.float64()), ("change", pa.float64())]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


def _first_vector(rows: pa.Table) -> pa.Table:
    """A block of nodes as one row of arrays."""
    p, out = np.zeros(rows.num_rows), np.zeros(rows.num_rows)
    at = rows["at"].to_numpy()
    p[at], out[at] = rows["p"].to_numpy(), rows["out"].to_numpy()
    return _vectors([_vector(rows["b"][0].as_py(), p, p, out, 0.0)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in order of their blocks as rows of arrays, each of one pair of blocks and of at most about `LINKS` links."""
    kinds = pa.schema([("sb", pa.int32()), ("db", pa.int32()), ("src", pa.binary()), ("dst", pa.binary()), ("times", pa.binary())])
    held: list[tuple] = []
    own, size = None, 0

    def row() -> pa.RecordBatch:
        arrays = [np.concatenate(x).tobytes() for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*own, *arrays), strict=True))], kinds)

    for batch in batches:
        sb, db = batch["sb"].to_numpy(), batch["db"].to_numpy()
        columns = [batch[c].to_numpy().astype(t) for c, t in (("src", np.int32), ("dst", np.int32), ("times", np.int32))]
        cuts = [0, *(np.flatnonzero((np.diff(sb) != 0) | (np.diff(db) != 0)) + 1).tolist(), len(sb)]
        for first, end in zip(cuts, cuts[1:]):
            if first == end:
                continue
            if held and (own != (sb[first], db[first]) or size > LINKS):
                yield row()
                held, size = [], 0
            own, size = (int(sb[first]), int(db[first])), size + end - first
            held.append(tuple(c[first:end] for c in columns))
    if held:
        yield row()


def _gotten(block: int):
    """What each block of nodes gets from the links of a task: 16 blocks at most are held before they are handed on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["b", "got"])
            sums.clear()
            return found

        for batch in batches:
            for k, db in enumerate(batch["db"].to_pylist()):
                src, dst, times, share = (np.frombuffer(batch[c][k].as_buffer(), t) for c, t in (("src", np.int32), ("dst", np.int32), ("times", np.int32), ("share", np.float64)))
                own = np.bincount(dst, share[src] * times, block)
                if db in sums:
                    sums[db] += own
                else:
                    if len(sums) == 16:
                        yield told()
                    sums[db] = own
        if sums:
            yield told()

    return read


def _next_vector(damping: float, lost: float):
    """A block's ranks after a round, of its ranks before and all that it gets."""

    def step(rows: pa.Table) -> pa.Table:
        old = next(r for r in rows.select(["b", "rank", "p", "out"]).filter(pc.is_valid(rows["rank"])).to_pylist())
        rank, p, out = (np.frombuffer(old[c]) for c in ("rank", "p", "out"))
        got = np.zeros(len(rank))
        for chunk in rows["got"].chunks:
            for value in chunk:
                if value.is_valid:
                    got += np.frombuffer(value.as_buffer())[: len(got)]
        after = damping * (got + lost * p) + (1 - damping) * p
        return _vectors([_vector(old["b"], after, p, out, float(np.abs(after - rank).sum()))])

    return step


def _unpacked(block: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, rank in zip(batch["b"].to_pylist(), batch["rank"].to_pylist(), strict=True):
                rank = np.frombuffer(rank)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rank), dtype=np.int64) + b * block), pa.array(rank)], ["_k", "rank"])

    return read


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, close: float = 1e-8) -> DataFrame:
    """(node, rank): parallel edges count as often as they are; mass of nodes without edges out goes to the personal vector (seeds: node, weight;
    all nodes alike without). Rounds end when ranks change by less than `close` together.

    Nodes are numbered, in the order of a digest so that none of their blocks has many more links than others. The links are written once, as arrays of
    numbers for each pair of blocks, in buckets by the block that they start from; a round moves the vector's blocks to the buckets and what each
    bucket tells of a block back, and no link. A task holds a few blocks, however many nodes there are.
    """
    spark = edges.sparkSession
    links = stage(edges.groupBy("src", "dst").agg(F.count("*").alias("times")))
    ends = links.select(F.col("src").alias("node"), F.col("times").alias("out")).union(links.select("dst", F.lit(0).cast("long")))
    nodes = numbered(ends.groupBy("node").agg(F.sum("out").alias("out")).withColumn("_hash", F.xxhash64("node")), ["_hash", "node"], "_k")
    nodes = stage(nodes.select("node", "out", (F.col("_k") - 1).alias("_k")))
    n = nodes.count()
    buckets = min(BUCKETS, links.count() // 1_000_000 + 1)
    block = min(NODES, max(1024, -(-n // buckets)))
    if seeds is None:
        personal = nodes.withColumn("p", F.lit(1.0 / max(n, 1)))
    else:
        total = seeds.agg(F.sum("weight")).first()[0] or 1.0
        weights = seeds.groupBy("node").agg(F.sum("weight").alias("weight"))
        personal = nodes.join(weights, "node", "left").withColumn("p", F.coalesce(F.col("weight"), F.lit(0.0)) / total)
    b, at = F.floor(F.col("_k") / block).cast("int"), (F.col("_k") % block).cast("int")
    vector = stage(personal.select(b.alias("b"), at.alias("at"), "p", F.col("out").cast("double")).groupBy("b").applyInArrow(_first_vector, VECTOR))
    matrix = links.join(nodes.select(F.col("node").alias("src"), b.alias("sb"), at.alias("_from")), "src").join(nodes.select(F.col("node").alias("dst"), b.alias("db"), at.alias("_to")), "dst")
    matrix = matrix.select("sb", "db", F.col("_from").alias("src"), F.col("_to").alias("dst"), "times").repartition(buckets, "sb").sortWithinPartitions("sb", "db")
    matrix = matrix.mapInArrow(_packed, "sb int, db int, src binary, dst binary, times binary")
    name = f"links_{uuid.uuid4().hex}"
    matrix.write.bucketBy(buckets, "sb").format("parquet").option("path", stage_path(spark)).saveAsTable(name)
    for _ in range(rounds):
        lost = vector.agg(F.sum("lost")).first()[0] or 0.0
        told = vector.select(F.col("b").alias("sb"), "share").hint("shuffle_hash").join(spark.table(name), "sb").mapInArrow(_gotten(block), "b int, got binary")
        every = vector.select("b", "rank", "p", "out").unionByName(told, allowMissingColumns=True)
        vector = stage(every.groupBy("b").applyInArrow(_next_vector(damping, lost), VECTOR))
        if (vector.agg(F.sum("change")).first()[0] or 0.0) < close:
            break
    spark.sql(f"DROP TABLE {name}")
    ranks = vector.select("b", "rank").mapInArrow(_unpacked(block), "_k long, rank double")
    return nodes.join(ranks, "_k").select("node", "rank")
