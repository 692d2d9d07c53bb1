"""Circuit breakers over results of calls, as a stream with timers and over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import stage

OPENINGS = "key long, opened long, closed long, failures int, held int"


class Breaker(StatefulProcessor):
    """A key's failures in a row, its opening, and the results that the watermark hasn't passed yet; these wait until no earlier one can come. A timer ends
    an opening that no result ends. A key whose last result succeeded holds nothing, so state is bounded by what lies within the lateness."""

    def __init__(self, limit: int, reset: int):
        self.limit, self.reset = limit, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "row int, opened long, last long, failures int, times array<long>, ids array<long>, failed array<boolean>")

    def _settled(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        row, opened, last, failures, times, ids, failed = self.state.get() if self.state.exists() else (0, None, None, 0, [], [], [])
        waiting = sorted({*zip(times, ids, failed, strict=True), *new})
        told = []
        while waiting and waiting[0][0] < watermark:
            time, _, bad = waiting.pop(0)
            if opened is not None and (not bad or time > last + self.reset):
                told.append((opened, min(time, last + self.reset), failures))
                opened = None
            row = row + 1 if bad else 0
            if row >= self.limit:
                opened, failures = (time, 1) if opened is None else (opened, failures + 1)
                last = time
        if opened is not None and last + self.reset < watermark:
            told.append((opened, last + self.reset, failures))
            opened = None
        if row == 0 and not waiting:
            self.state.clear()
        else:
            times, ids, failed = ([list(x) for x in zip(*waiting, strict=True)] if waiting else ([], [], []))
            self.state.update((min(row, self.limit), opened, last, failures, times, ids, failed))
        due = ([waiting[0][0]] if waiting else []) + ([last + self.reset] if opened is not None else [])
        if due:
            self.handle.registerTimer(min(due) + 1)
        if told:
            first, end, counts = zip(*told, strict=True)
            yield pd.DataFrame({"key": [key[0]] * len(told), "opened": first, "closed": end, "failures": counts, "held": [len(waiting)] * len(told)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(pdf["ms"].tolist(), pdf["id"].tolist(), pdf["failed"].tolist(), strict=True)]
        yield from self._settled(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _results(calls: DataFrame) -> DataFrame:
    known = calls.where("key IS NOT NULL AND time IS NOT NULL AND id IS NOT NULL")
    return known.select("key", "time", "id", F.coalesce("failed", F.lit(False)).alias("failed"), F.unix_millis(F.col("time").cast("timestamp")).alias("ms"))


def openings(calls: DataFrame, limit: int, reset: int, late: str) -> DataFrame:
    """A stream of (key, id, time, failed) to (key, opened, closed, failures, held), times in milliseconds.

    The `limit`th failure in a row opens a key's circuit, and each further one keeps it open for `reset` seconds more; a success closes it. An opening is
    told once the watermark, `late` behind the newest time, has passed its end. Results come in any order within the lateness, and repeats of one count
    once; results of one millisecond are ordered by id. Rows without key, id or time don't count, an unknown `failed` is a success.
    """
    marked = _results(calls.withWatermark("time", late))
    return marked.groupBy("key").transformWithStateInPandas(statefulProcessor=Breaker(limit, reset * 1000), outputStructType=OPENINGS, outputMode="Append", timeMode="EventTime")


def openings_in(calls: DataFrame, limit: int, reset: int, late: int) -> DataFrame:
    """The same of a table at its end: (key, opened, closed, failures), with the lateness in seconds.

    Results are dealt to ranges of key and time, so that a key with very many is spread over tasks; what a range needs of those before and after it (failures
    in a row, the next success, the last opening) comes from one row for each range and key.
    """
    results = _results(calls).drop("time").distinct()
    mark = results.agg((F.max("ms") - late * 1000).alias("_mark"))
    settled = results.join(F.broadcast(mark), F.col("ms") < F.col("_mark"))
    order = ["key", "ms", "id", "failed"]
    placed = stage(settled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    place, time = F.when(~F.col("failed"), F.col("_at")), F.when(~F.col("failed"), F.col("ms"))
    own, ranges, so_far = Window.partitionBy("key", "_part"), Window.partitionBy("key"), (Window.unboundedPreceding, 0)
    before, after = (ranges.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("_part"), F.desc("_part")))
    parts = placed.groupBy("key", "_part").agg(F.max(place).alias("_last"), F.min(time).alias("_first"), F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.max("ms").alias("_ms"))
    parts = parts.withColumn("_since", F.count("_last").over(ranges.orderBy("_part").rowsBetween(*so_far))).withColumn("_tail", F.col("_to") - F.coalesce(F.col("_last"), F.col("_from") - 1))
    parts = parts.withColumn("_sum", F.sum("_tail").over(Window.partitionBy("key", "_since").orderBy("_part").rowsBetween(*so_far)))
    parts = parts.select("key", "_part", F.last("_sum").over(before).alias("_failed_in"), F.last("_ms").over(before).alias("_was_in"), "_from", F.last("_first", ignorenulls=True).over(after).alias("_good_in"))
    up, down = own.orderBy("_at"), own.orderBy(F.desc("_at")).rowsBetween(*so_far)
    rows = placed.select("*", F.last(place, ignorenulls=True).over(up.rowsBetween(*so_far)).alias("_run"), F.lag("ms").over(up).alias("_was"), F.last(time, ignorenulls=True).over(down).alias("_good"))
    rows = rows.where("failed").join(parts, ["key", "_part"])
    start = F.coalesce(F.col("_run"), F.col("_from") - 1 - F.coalesce(F.col("_failed_in"), F.lit(0)))
    rows = rows.withColumn("_n", F.col("_at") - start).where(F.col("_n") >= limit)
    fresh = (F.col("_n") == limit) | (F.col("ms") > F.coalesce("_was", "_was_in") + reset * 1000)
    open_ = stage(rows.select("key", "_part", "_at", "ms", "_mark", F.coalesce("_good", "_good_in").alias("_good"), F.when(fresh, F.col("_at")).alias("_fresh")))
    told = open_.groupBy("key", "_part").agg(F.max("_fresh").alias("_last")).select("key", "_part", F.last("_last", ignorenulls=True).over(before).alias("_fresh_in"))
    marked = open_.withColumn("_own", F.last("_fresh", ignorenulls=True).over(up.rowsBetween(*so_far))).join(told, ["key", "_part"])
    found = marked.groupBy("key", F.coalesce("_own", "_fresh_in").alias("_opening")).agg(F.min("ms").alias("opened"), F.max("ms").alias("_last"), F.first("_good").alias("_good"), F.first("_mark").alias("_mark"), F.count("*").cast("int").alias("failures"))
    over = found.withColumn("closed", F.least(F.col("_last") + reset * 1000, F.col("_good")))
    return over.where("closed < _mark").select("key", "opened", "closed", "failures")
