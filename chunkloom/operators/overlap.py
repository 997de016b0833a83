"""Overlap: the last sentences of the packed chunk before, put in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import tokens as K
from ..plans.options import DEFAULTS, ChunkOptions


def document(key: str = "doc_id", order: str = "chunk_no"):
    """The window of a document's chunks; all stages share it, so rows are exchanged and sorted once."""
    return Window.partitionBy(key).orderBy(order)


def trailing_sentences(c: Column, n: int) -> Column:
    if n <= 0:
        return F.lit("")
    s = X.sentences(c)
    return F.array_join(F.slice(s, -F.least(F.lit(n), F.size(s)), F.lit(n)), " ")


def add_overlap(chunks: DataFrame, o: ChunkOptions = DEFAULTS, key: str = "doc_id") -> DataFrame:
    """Changes content and tokens of all but a document's first chunk, unless the maximum forbids it."""
    before = F.lag("content").over(document(key))
    tail = trailing_sentences(F.col("_before"), o.overlap_sentences)
    longer = F.concat(F.col("_tail"), F.lit(" "), F.col("content"))
    rows = chunks.withColumn("_before", before).withColumn("_tail", tail).withColumn("_n", K.count(longer, o.ranks_file))
    take = F.col("_before").isNotNull() & (F.col("_tail") != "") & (F.col("_n") <= o.max_tokens)
    rows = rows.withColumn("_take", F.coalesce(take, F.lit(False)))
    rows = rows.withColumn("content", F.when(F.col("_take"), longer).otherwise(F.col("content")))
    return rows.withColumn("tokens", F.when(F.col("_take"), F.col("_n")).otherwise(F.col("tokens"))).drop("_before", "_tail", "_take", "_n")
