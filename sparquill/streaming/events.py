"""Event logs: folding into current state, in batch and as a stream, and checks of their order."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Which status may follow which, for jobs and for runs.
JOB_TRANSITIONS = {
    "created": ["dispatching", "cancelled", "failed"],
    "dispatching": ["running", "cancelled", "failed"],
    "running": ["normalizing", "synthesizing", "completed", "partial", "failed", "cancelled"],
    "normalizing": ["synthesizing", "completed", "partial", "failed", "cancelled"],
    "synthesizing": ["completed", "partial", "failed", "cancelled"],
}
RUN_TRANSITIONS = {
    "queued": ["starting", "cancelled", "failed"],
    "starting": ["researching", "failed", "timed_out", "cancelled", "queued"],
    "researching": ["normalizing", "failed", "timed_out", "cancelled", "queued"],
    "normalizing": ["succeeded", "failed", "timed_out", "cancelled"],
}


def fold(events: DataFrame, by: str, seq: str, kind: str, value: str, counted: list[str]) -> DataFrame:
    """State of each group from events that count once by seq: the status with the highest seq, the last value that isn't null, and how many events
    there are of each counted kind."""
    once = events.dropDuplicates([by, seq])
    return once.groupBy(by).agg(
        F.max(seq).alias("last_seq"),
        F.max_by(kind, seq).alias("status"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq))).alias("last_value"),
        F.count("*").alias("events"),
        *(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in counted),
    )


class Reducer(StatefulProcessor):
    """The same fold over a stream, per key: replayed seqs are ignored, and a status of a lower seq than the last one is late and only counted. The highest
    `keep` seqs are held, whatever number of events a key has; once so many are held, a seq below all of them counts as replayed."""

    def __init__(self, keep: int = 1000):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last_seq long, status string, last_value double, value_seq long, events long, seen array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, status, value, value_seq, n, seen = self.state.get() if self.state.exists() else (-1, None, None, -1, 0, [])
        ring, held = sorted(seen), set(seen)
        for pdf in rows:
            for seq, kind, v in zip(pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["value"].tolist(), strict=True):
                if seq in held or len(ring) == self.keep and seq < ring[0]:
                    continue
                insort(ring, seq)
                held.add(seq)
                if len(ring) > self.keep:
                    held.discard(ring.pop(0))
                n += 1
                if seq > last:
                    last, status = seq, kind
                if v == v and v is not None and seq > value_seq:
                    value, value_seq = v, seq
        self.state.update((last, status, value, value_seq, n, ring))
        yield pd.DataFrame({"key": [key[0]], "last_seq": [last], "status": [status], "last_value": [value], "events": [n], "held": [len(ring)]})

    def close(self) -> None:
        pass


FOLDED = "key long, last_seq long, status string, last_value double, events long, held int"


def fold_stream(events: DataFrame, keep: int = 1000) -> DataFrame:
    """A stream of (key, seq, kind, value) to the state of each key, whenever it changes; `held` is how many seqs the state holds."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Reducer(keep), outputStructType=FOLDED, outputMode="Update", timeMode="None")


def violations(events: DataFrame, by: str, order: list[str], status: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(by, before, after, n): changes of status that the table of transitions doesn't have."""
    before = F.lag(status).over(Window.partitionBy(by).orderBy(*order))
    pairs = events.withColumn("before", before).where(F.col("before") != F.col(status))
    table = events.sparkSession.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], f"before string, {status} string")
    bad = pairs.join(F.broadcast(table), ["before", status], "left_anti")
    return bad.groupBy(by, "before", F.col(status).alias("after")).agg(F.count("*").alias("n"))


def runs(events: DataFrame, by: str, order: list[str], flag: Column) -> DataFrame:
    """(by, run, flagged, n, first, last): maximal runs of events with or without the flag, in order."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = events.withColumn("_f", F.coalesce(flag, F.lit(False)))
    fresh = F.coalesce((F.lag("_f").over(w) != F.col("_f")).cast("int"), F.lit(1))
    numbered = marked.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, F.col("_run").alias("run")).agg(F.first("_f").alias("flagged"), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def breakers(events: DataFrame, by: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """(by, opened, longest): how often `limit` failures in a row open the circuit, and the longest run of failures."""
    return runs(events, by, order, failed).where("flagged").groupBy(by).agg(F.count_if(F.col("n") >= limit).alias("opened"), F.max("n").alias("longest"))


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def eta(events: DataFrame, by: str, phase: str, time: str, done: Column, total: Column) -> DataFrame:
    """Adds rate (steps a second since the phase's first event) and seconds left; null while there is no rate."""
    first = F.min(time).over(Window.partitionBy(by, phase))
    seconds = (_micros(F.col(time)) - _micros(first)) / 1e6
    rate = F.when((seconds > 0) & (done > 0), done / seconds)
    return events.withColumn("rate", rate).withColumn("left", F.when(rate > 0, F.greatest(total - done, F.lit(0)) / rate))


def stuck(runs_: DataFrame, status: str, heartbeat: str, now: Column, active: list[str], seconds: int = 120) -> DataFrame:
    """Active runs whose last sign of life is missing or too long ago."""
    late = F.col(heartbeat).isNull() | (_micros(now) - _micros(F.col(heartbeat)) > seconds * 1_000_000)
    return runs_.where(F.col(status).isin(active) & late)


def finished(runs_: DataFrame, job: str, terminal: Column, good: Column, cancelled: Column) -> DataFrame:
    """(job, runs, good, outcome) of jobs all of whose runs have ended."""
    found = runs_.groupBy(job).agg(F.bool_and(terminal).alias("over"), F.count("*").alias("runs"), F.count_if(good).alias("good"), F.count_if(cancelled).alias("cancelled")).where("over")
    outcome = F.when(F.col("good") == F.col("runs"), "completed").when(F.col("good") > 0, "partial").when(F.col("cancelled") == F.col("runs"), "cancelled").otherwise("failed")
    return found.select(job, "runs", "good", outcome.alias("outcome"))


def append_new(batch: DataFrame, path: str, id: str) -> None:
    """For foreachBatch: append the rows whose id the table at path doesn't have yet, so that a batch that is run again adds nothing."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([id])
    try:
        new = new.join(spark.read.parquet(path).select(id), id, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def replayed(spark: SparkSession, pattern: str, schema: str, seq: str, after: int, path: str, log: str, kept: int = 500) -> None:
    """Replay an event log from a cursor: events of files read as a stream, those after the cursor appended once each; the checkpoint at `log` is the cursor
    of the next call. A batch takes `kept` files at most."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", kept).parquet(pattern).where(F.col(seq) > after)
    write = rows.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    write.foreachBatch(lambda batch, _: append_new(batch, path, seq)).start().awaitTermination()


def ingested(docs: DataFrame, path: str, log: str) -> None:
    """Ingest a stream of documents: each micro-batch replaces its own partition of the table, so that one that was cut short and runs again leaves no half
    and no double."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    docs.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


class Watch(StatefulProcessor):
    """Signs of life of a key as milliseconds. A sign is dropped once another follows within `limit` and no earlier one can come; one that none follows is
    told as soon as the watermark has passed its time by `limit`. So the state holds what lies within the lateness, and nothing of a key that is told."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "signs array<long>")

    def _told(self, key, signs: list[int], watermark: int) -> Iterator[pd.DataFrame]:
        following = [*signs[1:], None]
        alive = [n is not None and n - t <= self.limit for t, n in zip(signs, following, strict=True)]
        silent = [t for t, ok in zip(signs, alive, strict=True) if not ok and t + self.limit < watermark]
        kept = [t for t, ok in zip(signs, alive, strict=True) if (t >= watermark if ok else t + self.limit >= watermark)]
        if kept:
            self.state.update((kept,))
            waiting = [t for t, ok in zip(signs, alive, strict=True) if not ok and t + self.limit >= watermark]
            if waiting:
                self.handle.registerTimer(waiting[0] + self.limit + 1)
        else:
            self.state.clear()
        if silent:
            yield pd.DataFrame({"key": [key[0]] * len(silent), "last": silent, "held": [len(kept)] * len(silent)})

    def _signs(self) -> set[int]:
        return set(self.state.get()[0]) if self.state.exists() else set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signs = self._signs()
        for pdf in rows:
            signs.update(pdf["ms"].tolist())
        yield from self._told(key, sorted(signs), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, sorted(self._signs()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def silences(beats: DataFrame, seconds: int, late: str) -> DataFrame:
    """A stream of (key, time) to (key, last in milliseconds, held): each sign of life that no other follows within `seconds`, once the watermark, which
    stays `late` behind the newest time, has passed that time. Signs that come later than that are dropped; order and repeats of the others don't matter."""
    marked = beats.where(F.col("key").isNotNull() & F.col("time").isNotNull()).withWatermark("time", late).select("key", "time", F.unix_millis(F.col("time").cast("timestamp")).alias("ms"))
    return marked.groupBy("key").transformWithStateInPandas(statefulProcessor=Watch(seconds * 1000), outputStructType="key long, last long, held int", outputMode="Append", timeMode="EventTime")


def silences_in(beats: DataFrame, seconds: int, late: int) -> DataFrame:
    """The same of a table at its end: (key, last in milliseconds), with the lateness in seconds."""
    signs = beats.where(F.col("key").isNotNull() & F.col("time").isNotNull()).select("key", F.unix_millis(F.col("time").cast("timestamp")).alias("last")).distinct()
    mark = signs.agg((F.max("last") - late * 1000).alias("_mark"))
    then = F.lead("last").over(Window.partitionBy("key").orderBy("last"))
    ended = signs.withColumn("_next", then).where(F.col("_next").isNull() | (F.col("_next") - F.col("last") > seconds * 1000))
    return ended.join(F.broadcast(mark), F.col("last") + seconds * 1000 < F.col("_mark")).select("key", "last")


def once_within(events: DataFrame, id: str, time: str, late: str) -> DataFrame:
    """A stream in which each idempotency key passes once; a key's state is dropped when the watermark, `late` behind the newest time, has passed it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([id])
