"""Shared pieces of the corpus operators: shared folder, written tables, table reads, word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
_MASK64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 19  # bytes of text hashed at once
_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether one machine runs all: a path of its own is then seen by every task."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets one made and set; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif is_local(spark):
            base = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
            spark.sparkContext.setCheckpointDir(base)
            on_exit(spark, base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with a scheme; a bare path is a local one only where one machine runs all."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    if is_local(spark):
        return "file://" + os.path.abspath(folder)
    base = spark._jsc.hadoopConfiguration().get("fs.defaultFS")
    if base.startswith("file:"):
        raise ValueError(f"{folder}: name the file system, as every executor must see the folder")
    return base.rstrip("/") + "/" + folder.lstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def on_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    where, p = _hadoop(spark, path)
    where.deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    where, p = _hadoop(df.sparkSession, df._written)
    where.delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def with_text(docs: DataFrame) -> DataFrame:
    """``docs`` whose text is a string; the column keeps its place, so no further column can clash with it."""
    return docs.withColumn("text", F.col("text").cast("string"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) + 1
        edges = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _pow_cache:
        _pow_cache.clear()
        both = []
        for base in (_P, _P_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        _pow_cache[size] = tuple(both)
    return _pow_cache[size]


#: Bytes that belong to words: ASCII letters and digits, and all bytes of non-ASCII characters.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(text: pa.Array, places: bool = False) -> tuple[np.ndarray, ...]:
    """(row, hash) of each word of lower-cased ``text``, in order; null rows have none.

    With ``places`` also each word's first byte, and the lower-cased bytes, of all rows on end.

    Words are runs of WORD_BYTE. The hash is a polynomial over a word's bytes, taken from
    prefix sums, so there is no Python loop over words or characters.
    """
    low = pc.utf8_lower(pc.fill_null(text, "").cast(pa.large_string()))
    off = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin, end = int(off[0]), int(off[-1])
    rows, hashes, first_bytes, at = [], [], [], begin
    while at < end:
        stop = min(end, at + _BLOCK)
        while stop < end:  # cut between words
            tail = np.flatnonzero(~WORD_BYTE[raw[at:stop]])
            if len(tail):
                stop = at + int(tail[-1]) + 1
                break
            stop = min(end, stop + _BLOCK)
        buf = raw[at:stop]
        n = len(buf)
        word = WORD_BYTE[buf]
        first = np.zeros(n + 1, bool)  # a document begins here
        inside = off[(off > at) & (off < stop)] - at
        first[inside] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | first[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:n]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        rows.append(np.searchsorted(off, s + at, side="right") - 1)
        first_bytes.append(s + (at - begin))
        at = stop
    out = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (hashes, np.uint64), (first_bytes, np.int64))]
    return (*out, raw[begin:end], off - begin) if places else tuple(out[:2])


BUCKET_BITS = 16


def word_buckets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count): words of each row hashed to 2**BUCKET_BITS buckets, sorted by row, bucket."""
    rows, h = word_hashes(text)
    key = (rows.astype(np.uint64) << _U(BUCKET_BITS)) | (h >> _U(64 - BUCKET_BITS))
    if len(text) < 1 << (32 - BUCKET_BITS):
        key = key.astype(np.uint32)
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    key = key[new].astype(np.int64)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), count
