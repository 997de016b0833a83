"""Python functions over columns of texts, through Arrow, in slices of bounded size.

A batch from the JVM has a number of rows, not of bytes. What Python makes of it (strings, lists)
takes several times its bytes, so a batch is gone through in slices of some bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that are Python strings at once.
LIMIT = 1 << 20


def sizes(a: pa.Array) -> np.ndarray:
    """Bytes of each row of an array of texts or numbers, or of lists of these."""
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        inner = np.r_[0, np.cumsum(sizes(a.flatten()))]
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(a), 0)).astype(np.int64))
        return inner[ends] - inner[np.r_[0, ends[:-1]]] + 1 if len(a) else np.zeros(0, np.int64)
    if pa.types.is_primitive(a.type):
        return np.full(len(a), 8, np.int64)
    return np.asarray(pc.fill_null(pc.binary_length(a), 0)).astype(np.int64) + 1


def cuts(size: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(first, end) of slices whose sizes add up to about ``limit`` at most, or of one row."""
    if not len(size):
        return []
    inner = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    edges = [0, *inner.tolist(), len(size)]
    return list(zip(edges, edges[1:]))


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text in the column with that number has about LIMIT bytes at most, or in one row."""
    for b in batches:
        for i, j in cuts(sizes(b.column(column))):
            yield b.slice(i, j - i)


def texts(a: pa.Array) -> list:
    """The rows as Python values; bytes that are no UTF-8 become the mark for that, as in the JVM."""
    try:
        return a.to_pylist()
    except UnicodeDecodeError:
        decode = lambda x: None if x is None else [decode(y) for y in x] if isinstance(x, list) else x.decode("utf-8", "replace")
        flat = lambda t: pa.list_(pa.binary()) if pa.types.is_list(t) else pa.binary()
        return [decode(x) for x in a.cast(flat(a.type)).to_pylist()]


def each(c: Column, f: Callable[..., object], kind: str, *more: Column) -> Column:
    """``f`` of each row, as a column of the type ``kind``; null where ``c`` is. ``f`` also gets the values of ``more``."""
    to = to_arrow_type(T._parse_datatype_string(kind))

    def made(arrays: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        for i, j in cuts(sum(map(sizes, arrays))):
            rows = zip(*(texts(a.slice(i, j - i)) for a in arrays))
            yield pa.array([None if r[0] is None else f(*r) for r in rows], to)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield from made((a,))

    @F.arrow_udf(kind)
    def run_more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            yield from made(arrays)

    # not deterministic in name only: else the optimiser may move the call into a lambda, where Python can't run, or repeat it
    return (run_more if more else run).asNondeterministic()(c, *more)
