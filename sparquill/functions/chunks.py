"""Cutting texts into chunks. The cut of a chunk depends on the one before, so it runs over Arrow batches, a text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sentence ends after any of these, wherever it stands.
SENTENCE = re.compile(r"(?<=[。．.!?！？])")


def pieces(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs; the sentences of those that are too long; of sentences that are too long, parts of the size that share the overlap."""
    out = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        for part in [paragraph] if len(paragraph) <= size else filter(None, map(str.strip, SENTENCE.split(paragraph))):
            out += [part[k : k + size] for k in range(0, max(1, len(part) - overlap), size - overlap)]
    return out


def overlapping(text: str | None, size: int = 1200, overlap: int = 120) -> list[str]:
    """Pieces filled up to the size, joined by newlines; each chunk begins with the end of the one before."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    text = (text or "").replace("\r\n", "\n").strip()
    if len(text) <= size:
        return [text] if text else []
    out, buffer = [], ""
    for piece in pieces(text, size, overlap):
        if buffer and len(buffer) + 1 + len(piece) > size:
            out.append(buffer)
            buffer = buffer[-overlap:] if overlap else ""
        buffer = f"{buffer}\n{piece}" if buffer else piece
    return [c for c in map(str.strip, [*out, buffer]) if c]


def lines(text: str | None, size: int) -> list[str]:
    """Whole lines filled up to the size; longer lines are cut."""
    out, buffer = [], ""
    for line in (text or "").split("\n"):
        for part in [line[k : k + size] for k in range(0, len(line), size)] or [""]:
            if buffer and len(buffer) + 1 + len(part) > size:
                out.append(buffer)
                buffer = ""
            buffer = f"{buffer}\n{part}" if buffer else part
    return [*out, buffer] if buffer.strip() else out


def chunked(docs: DataFrame, id: str, text: str, size: int = 1200, overlap: int | None = 120) -> DataFrame:
    """(doc, pos, chunk, content): chunk is doc#pos. Without an overlap, texts are cut at lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = lines(value, size) if overlap is None else overlapping(value, size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["doc", "pos", "content"])

    rows = docs.select(F.col(id).cast("string").alias("doc"), F.col(text).alias("text")).mapInArrow(cut, "doc string, pos int, content string")
    return rows.select("doc", "pos", F.concat("doc", F.lit("#"), "pos").alias("chunk"), "content")
