"""Operator 1: packing along a space-filling curve.

A document's words are hashed to 2**16 buckets (weight 1 + log2(count), length one) and
projected by fixed signs to ``DIMS`` dimensions; each coordinate, about normal, is cut into
2**BITS levels of equal probability, and the cell's place on the Hilbert curve is the
document's key. Documents are range-sorted by key and joined into one stream of tokens, which
is cut into packs of ``capacity`` tokens: every pack but the last is full, and neighbours on
the curve share packs. A document may go on in the next pack.

Places are global without a global step: each sorted partition numbers its own tokens, and
the partitions' bases are prefix sums of their totals (one row for each partition). The
result does not depend on how the rows are partitioned. Only ids, keys and lengths are
sorted; ``packed`` brings the texts to their places by one shuffle and one sort on doc_id.

Tokens are words (runs of letters and digits) unless ``length`` names a column of counts.

Defined results: null, empty and wordless texts have no token and are in no pack; a text
longer than a pack has pieces in several, each cut out of the text once, however long it is; ties of the key are ordered by doc_id, then by a hash
of the text; repeated rows are each packed; an empty table gives no packs; further columns are
ignored; a null doc_id stays null.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import common as C

DIMS, BITS, CAPACITY = 4, 12, 2048
_TEXT = 1 << 20  # bytes of text that a worker takes at once; it keeps most of what it once took
_projection: np.ndarray | None = None


def projection() -> np.ndarray:
    """A row of DIMS signs for each word bucket; the same in every process."""
    global _projection
    if _projection is None:
        h = C.mix(np.arange(1, (1 << C.BUCKET_BITS) + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        _projection = np.stack([((h >> np.uint64(k)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(DIMS)], 1)
    return _projection


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Logistic approximation of the normal distribution function."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.07056 * x**3, -700, 700)))


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of n x d cell numbers, d * bits <= 63 (Skilling's transform)."""
    x = axes.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def keys_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(Hilbert key, number of words) of each text."""
    rows, bucket, count = C.word_buckets(text)
    n = np.zeros(len(text), np.int64)
    sums, norm = np.zeros((len(text), DIMS)), np.ones(len(text))
    if len(rows):
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        weight = 1 + np.log2(count)
        at = rows[start]
        n[at] = np.add.reduceat(count, start)
        sums[at] = np.add.reduceat(projection()[bucket] * weight[:, None], start, axis=0)
        norm[at] = np.sqrt(np.add.reduceat(weight**2, start))
    cells = np.minimum((_normal_cdf(sums / norm[:, None]) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert(cells), n


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.slices(batches, "text", _TEXT):
        key, n = keys_of(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("tie"), pa.array(key), b.column("given") if "given" in b.schema.names else pa.array(n)], ["doc_id", "tie", "key", "n"]
        )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row in its sorted partition."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = np.asarray(b.column("n"))
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("tie"), b.column("n"), pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))], ["doc_id", "tie", "n", "before", "part"]
        )
        before = int(ends[-1]) if len(ends) else before


def _placed(docs: DataFrame, length: str | None) -> DataFrame:
    """(doc_id, tie, n, at): each document with tokens and the number of tokens before it."""
    few = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"), *([F.col(length).cast("bigint").alias("given")] if length else []))
    id_ = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    kind = lambda *names: T.StructType([id_, *(T.StructField(x, T.IntegerType() if x == "part" else T.LongType()) for x in names)])
    keys = C.written(few.mapInArrow(_key_batches, kind("tie", "key", "n")).where("n > 0"), "keys")
    order = ["key", "doc_id", "tie"]
    numbered = C.written(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, kind("tie", "n", "before", "part")), "order")
    totals = numbered.groupBy("part").agg(F.sum("n").alias("total"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = totals.select("part", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("base"))
    return numbered.join(bases, "part").select("doc_id", "tie", "n", (F.col("base") + F.col("before")).alias("at"))


def _pieces(capacity: int) -> list[Column]:
    """Columns of the pieces of a document at ``at`` with ``n`` tokens, by pack number ``pack_id``."""
    first = F.col("pack_id") * capacity
    start = F.greatest(first - F.col("at"), F.lit(0)).alias("doc_start")
    return [
        F.col("pack_id"),
        F.greatest(F.col("at") - first, F.lit(0)).alias("pack_start"),
        F.col("doc_id"),
        start,
        F.least(first + capacity - F.col("at"), F.col("n")).alias("doc_end"),
    ]


def _cut(placed: DataFrame, capacity: int, *more: str) -> DataFrame:
    packs = F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("n") - 1) / capacity))
    return placed.select("*", F.explode(packs).alias("pack_id")).select(*_pieces(capacity), *more)


def pack(docs: DataFrame, capacity: int = CAPACITY, length: str | None = None) -> DataFrame:
    """(pack_id, pack_start, doc_id, doc_start, doc_end): a row for each piece of a document in a pack.

    Starts and ends count tokens, within the pack and within the document, ends exclusive.
    """
    return _cut(_placed(docs, length), capacity)


_PIECE = ["pack_id", "pack_start", "doc_id", "doc_start", "doc_end", "text"]


def _sliced(capacity: int, kind: pa.DataType, limit: int = _TEXT):
    """The pieces of each document with their texts, from one word's begin to another's; the first has what
    is before, the last what is after. A document's text is there once, whatever its pieces.

    Rows of a doc_id and tie lie together, its places (without a text) before its texts, which are alike:
    each text takes a place of its own, and one without a token finds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last_id, last_tie, places = None, None, deque()

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _PIECE)
            rows.clear()
            return batch

        for b in C.slices(batches, "text", limit):
            for id_, tie, t, n, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "text", "n", "at"))):
                if tie != last_tie or id_ != last_id and (id_ == id_ or last_id == last_id):  # NaN is one id
                    last_id, last_tie = id_, tie
                    places.clear()
                if t is None:
                    places.append((n, at))
                    continue
                if not places:
                    continue
                n, at = places.popleft()
                raw, first = t.encode(), None
                for p in range(at // capacity, (at + n - 1) // capacity + 1):
                    s, e = max(p * capacity - at, 0), min((p + 1) * capacity - at, n)
                    if first is None and e - s < n:
                        low = t.lower().encode()
                        word = C.WORD_BYTE[np.frombuffer(low if len(low) == len(raw) else raw, np.uint8)]
                        first = np.flatnonzero(word & ~np.r_[False, word[:-1]])
                    rows.append((p, max(at - p * capacity, 0), id_, s, e, raw[0 if s == 0 else first[s] : len(raw) if e == n else first[e]].decode()))
            yield out()

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` and the text of each piece. The pieces of a document make up its whole text."""
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    none = F.lit(None).cast("bigint")
    both = texts.select("doc_id", "tie", "text", none.alias("n"), none.alias("at")).unionAll(_placed(docs, None).select("doc_id", "tie", F.lit(None).cast("string").alias("text"), "n", "at"))
    # null ids are divided by their texts
    rows = both.repartition("doc_id", "tie").sortWithinPartitions("doc_id", "tie", F.col("at").asc_nulls_last())
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "text": T.StringType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in _PIECE])
    return rows.mapInArrow(_sliced(capacity, to_arrow_type(schema["doc_id"].dataType)), schema)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
