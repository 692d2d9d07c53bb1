"""Groups of items that fit a reader's context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def groups(sizes: list[int], most: int, room: int) -> list[int]:
    """The group of each item: a new one begins where an item would be one too many or the sizes would be too large. A larger item stands alone."""
    return _groups(sizes, most, room, START)[0]


#: Number of the group, its items and their sizes, before the first item.
START = 0, 0, 0


def _groups(sizes: list[int], most: int, room: int, before: tuple[int, int, int]) -> tuple[list[int], tuple[int, int, int]]:
    """The groups of items that come after others, and where they end."""
    out, (group, n, used) = [], before
    for size in sizes:
        if n and (n == most or used + size > room):
            group, n, used = group + 1, 0, 0
        n, used = n + 1, used + size
        out.append(group)
    return out, (group, n, used)


def packed(items: DataFrame, by: str, order: str, size: str, most: int = 6, room: int = 12_000) -> DataFrame:
    """(by, order, group). The place of an item depends on those before it, so the items of one document are read together: in one task and in order, but
    a batch at a time, many documents in one or one over many."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = object(), START
        for batch in batches:
            docs, sizes, out = batch.column(0).to_pylist(), batch.column(2).fill_null(0).to_pylist(), []
            cuts = [0, *(k for k in range(1, len(docs)) if docs[k] != docs[k - 1]), len(docs)] if docs else [0]
            for i, j in zip(cuts, cuts[1:]):
                own, before = _groups(sizes[i:j], most, room, before if docs[i] == last else START)
                last = docs[i]
                out += own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.int32))], [by, order, "group"])

    rows = items.select(by, order, F.col(size).cast("long").alias("_size")).repartition(by).sortWithinPartitions(F.asc(by), F.asc_nulls_last(order))
    return rows.mapInArrow(pack, StructType([items.schema[by], items.schema[order], StructField("group", IntegerType())]))
