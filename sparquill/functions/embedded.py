"""JSON within texts that say more than JSON."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WIDE = str.maketrans("｛｝［］：，＂", '{}[]:,"')


def _values(text: str):
    """Objects and arrays that can be decoded, outermost first, in order."""
    decoder, at = json.JSONDecoder(), 0
    while (m := re.compile(r"[\[{]").search(text, at)) is not None:
        try:
            value, at = decoder.raw_decode(text, m.start())
            yield value
        except ValueError:
            at = m.start() + 1


def first_value(text: str | None) -> str | None:
    """The first object or array; fences, commas before a closing bracket and full-width signs are forgiven."""
    bare = re.sub(r"```(?:json)?", "", (text or "").translate(WIDE))
    bare = re.sub(r",\s*([\]}])", r"\1", bare)
    found = next(_values(bare), None)
    return None if found is None else json.dumps(found, ensure_ascii=False)


def last_value(text: str | None) -> str | None:
    """The last object or array that stands by itself."""
    found = None
    for found in _values(text or ""):  # noqa: B007
        pass
    return None if found is None else json.dumps(found, ensure_ascii=False)


@F.arrow_udf(StringType())
def _first(texts: pa.Array) -> pa.Array:
    return pa.array([first_value(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _last(texts: pa.Array) -> pa.Array:
    return pa.array([last_value(t) for t in texts.to_pylist()], pa.string())


def first_json(text: Column | str) -> Column:
    return _first(text)


def last_json(text: Column | str) -> Column:
    return _last(text)
