"""Operator 4: compression bands.

A document's UTF-8 bytes are compressed as a whole and in fixed chunks of 2048 bytes with
zstandard (level 3, no content size in the frame). The ratio compressed / raw falls with
length, so the allowed band depends on it (``BANDS``): below the band a text repeats itself,
above it it is incompressible (keys, encoded data, noise). The upper limits lie between prose and
random alphanumerics of the same length (0.52 and 0.755 at most and at least from 2048 bytes on,
by the tables of sf0.1). A document is rejected when its whole ratio leaves its band, when over
``CHUNK_SHARE`` of its full chunks leave ``CHUNK_BAND``, or when over ``CHUNK_SHARE`` of its bytes
lie in chunks that do, the last partial chunk held against the upper limit of its own length; these
rules see a repetitive or random part of a long text whose whole ratio looks ordinary.

A text of under 2048 bytes is itself one partial chunk, judged by the band of its length, so every byte
of every text lies in a judged chunk, but for rests of under 24 bytes.

Defined results: null and empty texts are rejected (there is nothing to keep); texts under 24
bytes have no band and stay, as a frame's overhead is more than repetition saves, and last chunks under 24
bytes are not judged; under 64 bytes only the lower limit holds and under 192 bytes keys
and prose overlap, so the upper limit there is loose; hexadecimal digits compress like prose and are not
told from it; very long texts are read whole, chunk by chunk; repeated rows and copies get the same
verdict, so there are no ties to settle; an empty table gives an empty result; a document with a null id is judged like any
other; further columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEVEL, CHUNK = 3, 2048
#: (bytes from, least ratio, greatest ratio)
BANDS = [
    (0, 0.0, 99.0),
    (24, 0.80, 99.0),
    (32, 0.85, 99.0),
    (48, 0.70, 99.0),
    (64, 0.45, 1.40),
    (128, 0.42, 1.10),
    (192, 0.42, 0.87),
    (256, 0.42, 0.79),
    (512, 0.45, 0.74),
    (1024, 0.452, 0.69),
    (2048, 0.435, 0.65),
    (4096, 0.413, 0.63),
    (8192, 0.400, 0.61),
    (16384, 0.380, 0.60),
    (40000, 0.365, 0.60),
    (131072, 0.330, 0.60),
    (1048576, 0.280, 0.60),
]
CHUNK_BAND = (0.40, 0.65)
CHUNK_SHARE = 0.25
LAST = 24  # bytes that a last partial chunk must have to be judged
_FROM = np.array([b[0] for b in BANDS])
_LOW = np.array([b[1] for b in BANDS])
_HIGH = np.array([b[2] for b in BANDS])
_FIELDS = [("n_bytes", pa.int64()), ("ratio", pa.float64()), ("n_chunks", pa.int32()), ("bad_chunks", pa.int32())]


def ratios(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ratio, full chunks, chunks outside CHUNK_BAND, bytes of a bad last partial chunk) of each text; null counts as empty."""
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
    whole = pc.fill_null(text, "").cast(pa.large_string())
    off = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1].tolist()
    data = memoryview(whole.buffers()[2] or b"")
    n, ratio = np.zeros(len(text), np.int64), np.zeros(len(text))
    chunks, bad = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
    last = np.zeros(len(text), np.int64)
    for i, (a, b) in enumerate(zip(off, off[1:])):
        if b == a:
            continue
        n[i] = b - a
        ratio[i] = len(press(data[a:b])) / (b - a)
        chunks[i] = (b - a) // CHUNK
        for c in range(a, b - CHUNK + 1, CHUNK):
            r = len(press(data[c : c + CHUNK])) / CHUNK
            bad[i] += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
        rest = (b - a) % CHUNK
        if chunks[i] and rest >= LAST:
            r = len(press(data[b - rest : b])) / rest
            last[i] = 0 if CHUNK_BAND[0] <= r <= _HIGH[np.searchsorted(_FROM, rest, side="right") - 1] else rest
    return n, ratio, chunks, bad, last


def verdict(n: np.ndarray, ratio: np.ndarray, chunks: np.ndarray, bad: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which documents stay."""
    k = np.searchsorted(_FROM, n, side="right") - 1
    return (n > 0) & (ratio >= _LOW[k]) & (ratio <= _HIGH[k]) & (bad <= CHUNK_SHARE * chunks) & (bad.astype(np.int64) * CHUNK + last <= CHUNK_SHARE * np.maximum(n, 1))


def _kept(columns: list[str], scores: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            found = ratios(b.column("text"))
            keep = pa.array(verdict(*found))
            out = [b.column(c).filter(keep) for c in columns]
            names = list(columns)
            if scores:
                out += [pa.array(x, t).filter(keep) for x, (_, t) in zip(found, _FIELDS)]
                names += [f for f, _ in _FIELDS]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def compression_bands(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents, all columns kept."""
    docs = C.with_text(docs)
    return docs.mapInArrow(_kept(docs.columns, False), docs.schema)


def compression_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, ratio, n_chunks, bad_chunks) of each document that stays."""
    few = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([few.schema["doc_id"], *(T.StructField(f, T.LongType() if t == pa.int64() else T.DoubleType() if t == pa.float64() else T.IntegerType()) for f, t in _FIELDS)])
    return few.mapInArrow(_kept(["doc_id"], True), schema)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_scores(C.table(spark, sf_dir, "documents"))
