"""Operator 8: token ids in flat binary files.

Each partition of the documents is tokenised and written as one flat file of unsigned 16-bit
ids (32-bit for a vocabulary over 65,536), little-endian, without headers, so that a
reader maps it into memory. A second step turns the partitions' token totals into bases by
prefix sums and writes, beside each token file, a file of 64-bit offsets: for each document its
first token counted over all files, and in the end the partition's end. ``meta.json`` names
type, bases and counts. ``TokenFiles`` reads documents back through memory maps.

Every file is written under another name and renamed, so a repeated task replaces it by the
same bytes; the index between the two steps is a written table, so no token file is written
twice because of a lost executor later.

Defined results: very long texts are tokenised whole; a partition's order is that of its scan, so rows are never
compared and there are no ties; null and empty texts are documents of no tokens; every other document ends
with the separator id; copies are written as often as they occur; a document keeps its place
in its partition; an empty table gives no files and an empty result; further columns are
ignored; a null doc_id stays null in the index.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Where ``vocabulary`` is unset; every executor must see the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
_encoders: dict = {}


def encoder(vocabulary: str):
    import tiktoken

    if vocabulary not in _encoders:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[vocabulary] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def width(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


class _Atomic:
    """A file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.temporary = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def _write_tokens(folder: str, vocabulary: str, separator: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, at, out = TaskContext.get().partitionId(), 0, 0, None
        encode = encoder(vocabulary).encode_ordinary
        for b in C.slices(batches, "text"):
            if out is None:
                out = _Atomic(folder, f"tokens-{part:06d}.bin")
            ns = []
            for t in b.column("text").to_pylist():
                ids = encode(t) if t else []
                if t:
                    ids.append(separator)
                out.write(np.array(ids, kind).tobytes())
                ns.append(len(ids))
            n = np.array(ns, np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(ends - n), pa.array(n)],
                ["doc_id", "part", "row", "start", "n_tokens"],
            )
            row, at = row + len(n), int(ends[-1])
        if out is not None:
            out.close()

    return run


def _write_offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, end = None, None, 0
        for b in batches:
            parts, start, n = (np.asarray(b.column(c)) for c in ("part", "start", "n_tokens"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                if parts[i] != part:
                    if out is not None:
                        out.write(np.array([end], "<i8").tobytes())
                        out.close()
                    part = int(parts[i])
                    out = _Atomic(folder, f"offsets-{part:06d}.bin")
                out.write(start[i:j].astype("<i8").tobytes())
                end = int(start[j - 1] + n[j - 1])
            yield b.select(["doc_id", "part", "row", "start", "n_tokens"])
        if out is not None:
            out.write(np.array([end], "<i8").tobytes())
            out.close()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> tuple[DataFrame, str]:
    """Writes the files; gives the index (doc_id, part, row, start, n_tokens) and the folder."""
    spark = docs.sparkSession
    folder = C.uri(spark, folder or C.shared_dir(spark) + "-tokens")
    kind = width(max(encoder(vocabulary).n_vocab, separator + 1))
    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, part int, row bigint, start bigint, n_tokens bigint"
    local = C.written(few.mapInArrow(_write_tokens(folder, vocabulary, separator, kind), schema), "local-index")
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    bases = C.written(totals.withColumn("base", F.coalesce(F.sum("tokens").over(running), F.lit(0))), "bases")
    placed = local.join(bases.select("part", "base"), "part").withColumn("start", F.col("start") + F.col("base"))
    index = C.written(placed.select("doc_id", "part", "row", "start", "n_tokens").repartition("part").sortWithinPartitions("part", "row").mapInArrow(_write_offsets(folder), schema), "index")
    meta = {"dtype": kind, "vocabulary_size": encoder(vocabulary).n_vocab, "separator": separator, "parts": [r.asDict() for r in bases.orderBy("part").collect()]}
    out = _Atomic(folder, "meta.json")
    out.write(json.dumps(meta).encode())
    out.close()
    return index, folder


class TokenFiles:
    """Reads what ``write_tokens`` wrote through memory maps; documents are numbered over all files.

    Memory maps need a folder that this machine mounts.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file://")
        with open(f"{self.folder}/meta.json") as f:
            self.meta = json.load(f)
        self.parts = self.meta["parts"]
        self.first = np.cumsum([0, *(p["documents"] for p in self.parts)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def document(self, part: int, row: int) -> np.ndarray:
        k = next(i for i, p in enumerate(self.parts) if p["part"] == part)
        return self[int(self.first[k]) + row]

    def __getitem__(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, i, side="right")) - 1
        p = self.parts[k]
        offsets = np.memmap(f"{self.folder}/offsets-{p['part']:06d}.bin", "<i8", "r")
        a, b = (int(x) - p["base"] for x in offsets[i - self.first[k] : i - self.first[k] + 2])
        if a == b:
            return np.zeros(0, self.meta["dtype"])
        return np.memmap(f"{self.folder}/tokens-{p['part']:06d}.bin", self.meta["dtype"], "r")[a:b]


def op8_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return write_tokens(C.table(spark, sf_dir, "documents"), vocabulary=vocabulary)[0]
