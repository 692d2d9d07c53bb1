"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Fingerprints are cut into equal blocks, and those with equal population counts of all blocks form a tile. Two fingerprints within the radius have
population counts that differ by the radius at most (summed over the blocks), so every other pair of tiles is skipped. A tile receives the
fingerprints of the tiles that it is compared with; numpy takes exclusive-ors and counts bits for whole blocks of rows. Of the links a tile finds,
it emits a spanning forest only, never all pairs of a group. Copies of a text have one fingerprint and are compared once.

More blocks make smaller tiles that are met by more copies of each fingerprint: 4 blocks (21 copies) while the largest tile stays under `TILE`
fingerprints, as their number and the binomial law of population counts tell, else 8 (73 copies) or 16 (273); the links found are the same.

Defined results: a null text has no words, and texts without words share fingerprint zero; a null id is kept and named last; repeated rows link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, keep, placed, raw
from .components import components

SEED, SIDE, TILE = 42, 2048, 200_000


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """The fingerprint of each text as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t, shingle) for t in raw(texts)], np.uint64).view(np.int64))

    return of(text)


def _steps(blocks: int, radius: int) -> np.ndarray:
    """Differences of two tiles' counts within the radius, one of each pair of opposite ones; zero is left out."""
    reach = range(-radius, radius + 1)
    return np.array([d for d in product(reach, repeat=blocks) if 0 < sum(map(abs, d)) <= radius and next(filter(None, d)) < 0], np.int64).reshape(-1, blocks)


def _deal(radius: int, blocks: int):
    steps, width = _steps(blocks, radius), 64 // blocks
    scale = (width + 1) ** np.arange(blocks - 1, -1, -1, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(own.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(own), blocks, width).sum(axis=2, dtype=np.int64)
            tiles, homes, prints = [bits @ scale], [np.ones(len(own), bool)], [own]
            for step in steps:
                there = bits + step
                fits = ((there >= 0) & (there <= width)).all(axis=1)
                tiles.append(there[fits] @ scale), homes.append(np.zeros(fits.sum(), bool)), prints.append(own[fits])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tiles, homes, prints)], ["tile", "home", "print"])

    return deal


def _forest(home: np.ndarray, rest: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among `home` and between `home` and `rest`."""
    everything, parent = np.concatenate((home, rest)), {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = i = parent.get(p, p)
        return i

    found: tuple[list[int], list[int]] = ([], [])
    for a in range(0, len(home), SIDE):
        for b in range(a, len(everything), SIDE):
            near = np.bitwise_count(home[a : a + SIDE, None] ^ everything[None, b : b + SIDE]) <= radius
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                x, y = root(a + i), root(b + j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found[0].append(a + i), found[1].append(b + j)
    signed = everything.view(np.int64)
    return signed[found[0]].tolist(), signed[found[1]].tolist()


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, home, prints = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)

        def links(upto: int) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(tile[:upto])) + 1, [upto]))
            u, v = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1 and home[a:b].any():
                    x, y = _forest(prints[a:b][home[a:b]], prints[a:b][~home[a:b]], radius)
                    u += x
                    v += y
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            tile, home, prints = np.concatenate((tile, new[0])), np.concatenate((home, new[1])), np.concatenate((prints, new[2].astype(np.int64).view(np.uint64)))
            if len(tile) and (end := int(np.searchsorted(tile, tile[-1]))):
                yield from links(end)
                tile, home, prints = tile[end:], home[end:], prints[end:]
        if len(tile):
            yield from links(len(tile))

    return compare


def blocks_for(n: int) -> int:
    """The least number of blocks for which n fingerprints make tiles of `TILE` at most, if their bits are as random as a hash's."""
    for blocks in (4, 8):
        width = 64 // blocks
        if n * (comb(width, width // 2) / 2**width) ** blocks <= TILE:
            return blocks
    return 16


def links(prints: DataFrame, radius: int = 2, blocks: int | None = None) -> DataFrame:
    """Links (u, v) that connect whatever distinct fingerprints (column print) are connected within the radius."""
    blocks = blocks or blocks_for(prints.count())
    dealt = prints.mapInArrow(_deal(radius, blocks), "tile long, home boolean, print long")
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, blocks: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, print, part, component, and the columns to carry): one row for each row of docs. component is the least id reachable over links, itself
    included; part is the least fingerprint of the component, which tells components apart whatever ids they have."""
    own = keep(docs.select(docs[id].alias("_id"), fingerprint(docs[text], shingle).alias("print"), *carry), "prints")
    distinct = keep(own.groupBy("print").agg(F.min("_id").alias("least")), "distinct")
    parts = components(links(distinct.select("print"), radius, blocks))
    named = distinct.join(parts.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    of_print = named.select("print", "component").join(least, "component").select("print", F.col("component").alias("part"), F.col("least").alias("component"))
    return own.join(of_print, "print").select(F.col("_id").alias(id), "print", "part", "component", *carry)


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each component of docs: the one of least id (nulls last), the first in its files where several have that id or none has one."""
    row = free([*docs.columns, id, "print", "part", "component"], "_row")
    rows = placed(docs, row)
    found = near_duplicates(rows.select(rows[id].alias("_own"), rows[text].alias("_text"), row), "_own", "_text", radius, shingle, carry=(row,))
    first = found.groupBy("part").agg(F.min(F.struct(F.col("_own").isNull(), "_own", row)).alias("first"))
    return rows.join(first.select(F.col(f"first.{row}")), row, "left_semi").drop(row)
