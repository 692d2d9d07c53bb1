"""Streams with watermarks and timers against their batch forms."""

import random
from datetime import datetime, timedelta

from sparquill.streaming import breakers
from sparquill.streaming import events as ev

START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(stream, name, path):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination(200)


def test_silences_of_a_shuffled_stream_equal_the_table(spark, tmp_path):
    rng = random.Random(2)
    rows, now = [], 0.0
    for _ in range(150):
        now += rng.choice([5, 20, 20, 90, 200])
        rows.append((rng.randint(0, 2), now))
    rows += rows[10:40]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 100))  # out of order by less than the lateness
    beats = [(k, START + timedelta(seconds=t)) for k, t in rows]
    schema, n = "key long, time timestamp", 60
    beats = [*beats, (None, START), (1, None)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = ev.silences(_files(spark, str(tmp_path / "in"), [beats[i : i + n] for i in range(0, len(beats), n)], schema), 120, "100 seconds")
    _drained(stream, "silent", str(tmp_path / "cp"))
    got = spark.table("silent").collect()
    want = [tuple(r) for r in ev.silences_in(spark.createDataFrame(beats, schema), 120, 100).collect()]
    assert sorted((r.key, r.last) for r in got) == sorted(want) and len(want) > 10
    assert max(r.held for r in got) < 40


def test_keys_pass_once(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("b", at(9)), ("c", at(12)), ("a", at(3))]]
    _drained(ev.once_within(_files(spark, str(tmp_path / "in"), batches, "id string, time timestamp"), "id", "time", "30 seconds"), "once", str(tmp_path / "cp"))
    assert sorted(r.id for r in spark.table("once").collect()) == ["a", "b", "c"]


def _folded(calls, limit, reset, late):
    """One result after the other: (key, opened, closed, failures) of openings that are over before the last time less the lateness."""
    mark = max(c[2] for c in calls if c[2] is not None and c[0] is not None) - timedelta(seconds=late)
    found, step = [], timedelta(seconds=reset)
    for key in {c[0] for c in calls} - {None}:
        row, first, last, n = 0, None, None, 0
        rows = sorted({(c[2], c[1], bool(c[3])) for c in calls if c[0] == key and c[2] is not None})
        for time, _, bad in [r for r in rows if r[0] < mark]:
            if first and (not bad or time > last + step):
                found.append((key, first, min(time, last + step), n))
                first = None
            row = row + 1 if bad else 0
            if row >= limit:
                first, n, last = (time, 1, time) if not first else (first, n + 1, time)
        if first and last + step < mark:
            found.append((key, first, last + step, n))
    return sorted(found)


def test_openings_of_a_shuffled_stream_equal_the_table_and_a_fold(spark, tmp_path):
    rng = random.Random(5)
    rows, now = [], 0
    for i in range(400):
        now += rng.choice([0, 3, 10, 40, 150])
        rows.append((rng.randint(0, 3), i, now, rng.random() < 0.75))
    rows += rows[20:60]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 90))
    calls = [(k, i, START + timedelta(seconds=t), bad) for k, i, t, bad in rows]
    calls += [(None, 1000, START, True), (1, 1001, None, True), (2, 1002, calls[-1][2], None)]
    schema, n = "key long, id long, time timestamp, failed boolean", 90
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = breakers.openings(_files(spark, str(tmp_path / "in"), [calls[i : i + n] for i in range(0, len(calls), n)], schema), 3, 100, "100 seconds")
    _drained(stream, "opened", str(tmp_path / "cp"))
    got = spark.table("opened").collect()
    want = sorted(tuple(r) for r in breakers.openings_in(spark.createDataFrame(calls, schema), 3, 100, 100).collect())
    assert sorted((r.key, r.opened, r.closed, r.failures) for r in got) == want and len(want) > 10
    zero = spark.sql("SELECT unix_millis(timestamp'2024-01-01')").first()[0]
    ms = lambda t: zero + round((t - START).total_seconds() * 1000)
    assert want == [(k, ms(a), ms(b), n) for k, a, b, n in _folded(calls, 3, 100, 100)]
    assert any(r.failures > 1 for r in got) and max(r.held for r in got) < 40
