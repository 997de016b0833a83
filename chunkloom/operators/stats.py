"""Statistics of chunks by document, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as K
from ..plans.options import DEFAULTS, ChunkOptions


def compute_stats(chunks: DataFrame, o: ChunkOptions = DEFAULTS, key: str = "doc_id", content: str = "original_text", documents: DataFrame | None = None) -> DataFrame:
    """A row for each document; with ``documents``, also all zeros for those without a chunk."""
    target = o.stats_target
    tolerance = int(target * 0.1)
    t = F.coalesce(F.col("tokens"), F.lit(0))
    s = chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum(t).alias("total_tokens"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        X.half_up(F.avg(t)).alias("avg_tokens"),
        X.half_up(F.median(t)).alias("median_tokens"),
        F.sum(X.length(F.coalesce(F.col(content), F.lit("")))).alias("source_length"),
        F.count_if(t < target - tolerance).alias("under_target"),
        F.count_if(t.between(target - tolerance, target + tolerance)).alias("at_target"),
        F.count_if(t > target + tolerance).alias("over_target"),
    )
    s = s.withColumn("expected_chunks", F.ceil(F.ceil(F.col("source_length") / F.lit(K.PER_TOKEN)) / F.lit(float(target))))
    some = F.col("expected_chunks") > 0
    ratio = F.when(some, F.col("total_chunks") / F.col("expected_chunks")).otherwise(F.lit(0.0))
    deviation = F.when(some, F.abs(F.col("total_chunks") - F.col("expected_chunks")) / F.col("expected_chunks")).otherwise(F.lit(0.0))
    s = s.select(
        "*",
        F.col("total_chunks").alias("actual_chunks"),
        X.round2(ratio).alias("efficiency_ratio"),
        X.round2(deviation).alias("deviation"),
        X.round2(F.when(F.col("source_length") > 0, F.col("total_tokens") / F.col("source_length"))).alias("compression_ratio"),
        (deviation > 0.2).alias("quality_flag"),
    )
    if documents is None:
        return s
    all_ = documents.select(key).distinct().join(s, key, "left")
    return all_.select(key, *(F.coalesce(F.col(c), F.lit(False) if c == "quality_flag" else F.lit(0).cast(s.schema[c].dataType)).alias(c) for c in s.columns if c != key))


def token_buckets(chunks: DataFrame, key: str | None = None) -> DataFrame:
    """Sum, mean, extremes and buckets at 200 and 400 tokens, over all or by a key."""
    t = F.coalesce(F.col("tokens"), F.lit(0))
    rows = chunks.groupBy(*([key] if key else []))
    return rows.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(t).alias("total_tokens"),
        X.half_up(F.avg(t)).alias("avg_tokens"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        F.count_if(t < 200).alias("small"),
        F.count_if((t >= 200) & (t < 400)).alias("medium"),
        F.count_if(t >= 400).alias("large"),
    )


def type_histogram(chunks: DataFrame, types: str = "node_types") -> DataFrame:
    return chunks.select(F.explode(types).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def distinct_sections(section: str = "section_title") -> Column:
    return F.count_distinct(F.nullif(F.col(section), F.lit("")))


def source_rollup(chunks: DataFrame, source: str = "source") -> DataFrame:
    n = F.length("content")
    return chunks.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        X.half_up(F.avg(n)).alias("avg_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.bool_or(F.coalesce(F.size("header_path"), F.lit(0)) > 0).alias("has_hierarchy"),
        F.count_if(F.col("prev_id").isNotNull() | F.col("next_id").isNotNull()).alias("linked"),
    )


def relationship_counts(chunks: DataFrame, key: str | None = None) -> DataFrame:
    """Chunks that are linked, have a header hierarchy, or were found in their text (confidence over 0.8), over all or by a key."""
    return chunks.groupBy(*([key] if key else [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prev_id").isNotNull() | F.col("next_id").isNotNull()).alias("linked"),
        F.count_if(F.coalesce(F.col("hierarchy"), F.lit("")) != "").alias("with_hierarchy"),
        F.count_if(F.col("confidence") > 0.8).alias("located"),
    )
