"""Heading trails by windows.

A heading of depth d ends all entries of depth d and more. So level L is in a block's trail iff
the last heading of depth L came after the last of every smaller depth: six running maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = range(1, 7)


def heading_trail(blocks: DataFrame, key: str = "doc_id", order: str = "block_no") -> DataFrame:
    """Adds trail and depths to rows with type, text and depth; a heading's trail ends with itself."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = lambda level: (F.col("type") == "heading") & (F.col("depth") == level)
    last = blocks.select(
        "*",
        *(F.max(F.when(heading(k), F.col(order))).over(w).alias(f"_p{k}") for k in LEVELS),
        *(F.last(F.when(heading(k), F.col("text")), ignorenulls=True).over(w).alias(f"_h{k}") for k in LEVELS),
    )
    live = {k: F.col(f"_p{k}").isNotNull() & (F.col(f"_p{k}") > F.coalesce(F.greatest(*(F.col(f"_p{j}") for j in range(1, k)), F.lit(None)) if k > 1 else F.lit(-1), F.lit(-1))) for k in LEVELS}
    names = F.array_compact(F.array(*(F.when(live[k], F.struct(F.lit(k).alias("d"), F.col(f"_h{k}").alias("h"))) for k in LEVELS)))
    rows = last.withColumn("_t", names)
    rows = rows.withColumn("trail", F.transform("_t", lambda x: x["h"])).withColumn("depths", F.transform("_t", lambda x: x["d"]))
    return rows.drop("_t", *(f"_{c}{k}" for c in "ph" for k in LEVELS))
