"""Report lines of chunks and documents, as columns for a console or a text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WIDTH, BAR = 80, 40


def rule(char: str = "-", n: int = WIDTH) -> str:
    return char * n


def boxes(chunks: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Adds report: a header, a bar of tokens against the maximum and a preview of five lines."""
    filled = F.least(F.lit(BAR), F.floor(F.col("tokens") * BAR / max_tokens)).cast("int")
    bar = F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), BAR - filled))
    preview = F.transform(F.slice(F.split("content", "\n"), 1, 5), lambda x: F.concat(F.lit("| "), X.shortened(x, WIDTH - 4)))
    head = F.concat(F.lit("+ chunk "), (F.col("chunk_no") + 1).cast("string"), F.lit("  "), F.col("tokens").cast("string"), F.lit(" tokens  ["), bar, F.lit("]"))
    return chunks.withColumn("report", F.concat_ws("\n", head, F.array_join(preview, "\n"), F.lit("+" + rule(n=WIDTH - 1))))


def listing(chunks: DataFrame, content: int = 200, embed: int = 150) -> DataFrame:
    """Adds report: tokens, path, types and previews."""
    line = F.concat_ws(
        "\n",
        F.concat(F.lit("chunk "), (F.col("chunk_no") + 1).cast("string"), F.lit(": "), F.col("tokens").cast("string"), F.lit(" tokens")),
        F.concat(F.lit("  path: "), F.array_join("header_path", " > ")),
        F.concat(F.lit("  types: "), F.array_join("node_types", ", ")),
        F.concat(F.lit("  text: "), X.shortened(F.replace(F.col("content"), F.lit("\n"), F.lit(" ")), content)),
        F.concat(F.lit("  embed: "), X.shortened(F.replace(F.col("embed_text"), F.lit("\n"), F.lit(" ")), embed)),
    )
    return chunks.withColumn("report", line)


def as_json(rows: DataFrame, *without: str) -> DataFrame:
    """(json): each row as an object, null fields kept."""
    return rows.select(F.to_json(F.struct(*(c for c in rows.columns if c not in without)), {"ignoreNullFields": "false"}).alias("json"))
