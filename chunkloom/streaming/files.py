"""Chunking of files as they arrive. Parse, split, pack and normalise are row-local, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize, parse
from ..plans.options import DEFAULTS, ChunkOptions
from ..plans.pipeline import pack_stage


def documents(spark: SparkSession, path: str, suffix: str = ".md", files_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files_per_batch).schema("value string").load(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("title"), F.col("value").alias("text"))


def packed(docs: DataFrame, o: ChunkOptions = DEFAULTS) -> DataFrame:
    """Packed and normalised chunks of a stream (or table) of documents."""
    rows = parse.split_blocks(parse.parsed(docs), o)
    return normalize.normalize_chunks(pack_stage(o)(rows))


def start(docs: DataFrame, out: str, checkpoint: str, o: ChunkOptions = DEFAULTS) -> StreamingQuery:
    """Writes packed chunks as Parquet until what is there is done."""
    return packed(docs, o).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
