"""Results as JSON text in columns, and as a text table."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame

from graphloom.functions.procedures import value_type

#: Rows of one chunk of the encoded result.
CHUNK_ROWS = 65536


def chunks(df: DataFrame, rows: int = CHUNK_ROWS) -> Iterator[list[list]]:
    """Chunks of at most so many rows, each a list of columns. One partition at a time is on the driver."""
    names, part = df.columns, []
    for row in df.toLocalIterator():
        part.append(tuple(row))
        if len(part) == rows:
            yield [list(c) for c in zip(*part)]
            part = []
    if part:
        yield [list(c) for c in zip(*part)] if names else []


def encode(df: DataFrame, rows: int = CHUNK_ROWS) -> Iterator[str]:
    """Pieces of the JSON text {"header": {column_names, column_types}, "data": [chunk, ...], "time": milliseconds}."""
    began = time.perf_counter()
    header = {"column_names": df.columns, "column_types": [value_type(f.dataType) for f in df.schema.fields]}
    yield '{"header": ' + json.dumps(header) + ', "data": ['
    for k, chunk in enumerate(chunks(df, rows)):
        yield ", " * (k > 0) + json.dumps(chunk, default=str)
    yield f'], "time": {(time.perf_counter() - began) * 1000:.3f}}}'


def table(df: DataFrame, limit: int = 1000) -> str:
    """A text table of the first rows; null is written as such."""
    rows = [["null" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths)) + "|"
    return "\n".join([line, show(df.columns), line, *map(show, rows), line])
