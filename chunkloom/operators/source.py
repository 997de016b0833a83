"""Source metrics of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as K
from ..plans.options import DEFAULTS, ChunkOptions


def estimate_chunks(tokens: Column, o: ChunkOptions = DEFAULTS) -> Column:
    return F.when(tokens <= o.max_tokens, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(tokens / F.lit(float(o.source_target))).cast("int")))


def count(c: Column, o: ChunkOptions) -> Column:
    return K.count(c, o.ranks_file)


def source_metrics(docs: DataFrame, o: ChunkOptions = DEFAULTS, text: str = "text") -> DataFrame:
    """Adds length, tokens and estimated_chunks; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("length", X.length(t)).withColumn("tokens", count(t, o)).withColumn("estimated_chunks", estimate_chunks(F.col("tokens"), o))
