"""Line dedup: content-defined chunks of lines, of which repeats of several lines are removed.

A line ends a chunk unless a rolling hash over the hashes of the last `REACH` lines is divisible by `MEAN`, so boundaries follow content and lines put in
before shift nothing after them. What is compared are the chunks of several lines and, around each boundary, the lines before it with one line after it
and the lines after it with one before it, up to `SIDE` lines: so a repeated passage that begins or ends inside a chunk is found whole, and chunks
of one line are judged together with a neighbour. A passage of n lines between other lines is missed where it has no boundary that its own lines decide:
one third of passages of 3 lines, one ninth of 4, one in 730 of 8. Its first line may be missed too, since the line before it decides whether a chunk ends
there.

Of each such span with two lines or more that aren't blank all occurrences but the first (by id, row and place) are removed, if all that share its digest
agree in their bytes. Counts by digest are aggregated before the shuffle and joined back; only repeated spans carry their bytes. What is joined grows with the
documents, so a small table is joined as a large one is: by merges, nothing broadcast but the names of files.

Defined results: a null text has no lines, an empty one has one empty line; a null id counts as larger than every other; repeated rows repeat each
other; a document whose lines all go keeps an empty text; other columns are not read. Rows are numbered by their place in their files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, placed, portions, raw, release
from .repeats import NONE

REACH, MEAN, FACTOR, SIDE = 2, 3, 31, 8


def starts(lines: list[bytes]) -> list[int]:
    """The first lines of the chunks, and the number of lines."""
    out, rolling = [0] if lines else [], [0] * REACH
    for k, line in enumerate(lines, 1):
        rolling = [int.from_bytes(hashlib.md5(line).digest()[:4], "big"), *rolling[:-1]]
        if k == len(lines) or sum(h * FACTOR**j for j, h in enumerate(rolling)) % MEAN:
            out.append(k)
    return out


def spans(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """The half-open ranges of lines that are compared."""
    full = np.concatenate(([0], np.cumsum([bool(line.strip()) for line in lines]))).tolist()
    at = starts(lines)
    for a, x, b in zip([0, *at[:-1]], at[:-1], at[1:]):
        found = [(x, b)]
        if x:
            found += [(x - n, x + 1) for n in range(1, min(SIDE, x - a) + 1)] + [(x - 1, x + n) for n in range(2, min(SIDE, b - x - 1) + 1)]
        yield from (s for s in found if full[s[1]] - full[s[0]] > 1)


def _bodies(text: bytes | None, wanted: Iterator[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, bytes]]:
    lines = text.split(b"\n") if text is not None else []
    at = [0, *np.cumsum([len(line) + 1 for line in lines]).tolist()]
    for a, b in spans(lines) if wanted is None else wanted:
        yield a, b, text[at[a] : at[b] - 1]


def _batch(out: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


SPAN = [("row", pa.int64()), ("owner", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("key", pa.binary())]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows, owners = raw(batch.column("text")), batch.column("row").to_pylist(), batch.column("owner").to_pylist()
        for i, j in portions(texts, 4_000_000):
            yield _batch([(r, o, a, b, xxhash.xxh3_128_digest(c)) for t, r, o in zip(texts[i:j], rows[i:j], owners[i:j], strict=True) for a, b, c in _bodies(t)], SPAN)


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wanted = raw(batch.column("text")), batch.column("wanted").to_pylist()
        for i, j in portions(texts, 4_000_000):
            yield _batch([(xxhash.xxh3_128_digest(c), c) for t, own in zip(texts[i:j], wanted[i:j], strict=True) for _, _, c in _bodies(t, ((w["a"], w["b"]) for w in own))], [("key", pa.binary()), ("body", pa.binary())])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(raw(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            lines, drop = text.split(b"\n") if text is not None else [], {k for g in gone or () for k in range(g["a"], g["b"])}
            body = b"\n".join(line for k, line in enumerate(lines) if k not in drop)
            out.append((len(lines), max(0, len(starts(lines)) - 1), len(drop), body.decode(), hashlib.sha256(body).hexdigest()))
        rest = _batch(out, [("n_lines", pa.int64()), ("n_chunks", pa.int64()), ("n_removed_lines", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
        yield pa.RecordBatch.from_arrays([batch.column("id"), *rest.columns], ["id", *rest.schema.names])


def strip_chunks(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_lines, n_chunks, n_removed_lines, kept, kept_sha256) for each row of docs."""
    rows = placed(docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))).withColumn("owner", F.coalesce("id", F.lit(NONE)))
    keyed = keep(rows.select("row", "owner", "text").mapInArrow(_keys, "row long, owner long, a int, b int, key binary"), "spans").withColumn("place", F.struct("owner", "row", "a"))
    again = keep(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1"), "keys")  # read again, so that the join can split a hot key
    found = keep(keyed.join(again.hint("merge"), "key").select("row", "a", "b", "key", (F.col("place") != F.col("first")).alias("later")), "repeats")
    release(keyed), release(again)
    wanted = found.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("wanted"))
    bodies = rows.select("row", "text").join(wanted.hint("merge"), "row").select("text", "wanted").mapInArrow(_bytes, "key binary, body binary")
    differ = keep(bodies.groupBy("key", "body").agg(F.lit(1).alias("one")).groupBy("key").count().where("count > 1").select("key"), "differ")  # digests of several texts: none, in all likelihood
    gone = found.where("later").join(differ, "key", "left_anti").groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return rows.select("id", "text", "row").join(gone.hint("merge"), "row", "left").select("id", "text", "gone").mapInArrow(_strip, "id long, n_lines long, n_chunks long, n_removed_lines long, kept string, kept_sha256 string")
