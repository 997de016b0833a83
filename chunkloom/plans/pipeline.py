"""The chunking pipeline over documents (doc_id, title, text), as composed stages.

parse, split and pack are narrow: a document stays one row, with its blocks as an array. The
chunk rows are then exchanged once by doc_id; overlap, links, offsets and checks are windows
over that one partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import analyze as A
from ..operators import embed, guardrails, metadata, normalize, overlap, pack, parse, stats
from .options import DEFAULTS, ChunkOptions

Stage = Callable[[DataFrame], DataFrame]


def flow(*stages: Stage) -> Stage:
    """Stages applied in order."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df

    return run


def require(*columns: str) -> Stage:
    """A stage that fails when a column is missing."""

    def check(df: DataFrame) -> DataFrame:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return df

    return check


_ERROR = "array<struct<stage:string,message:string,recoverable:boolean>>"


def add_error(df: DataFrame, stage: str, when: Column, message: Column, recoverable: bool = False) -> DataFrame:
    """Appends an error to the rows where ``when`` holds, in the column errors; the rows go on."""
    errors = F.col("errors") if "errors" in df.columns else F.array().cast(_ERROR)
    one = F.array(F.struct(F.lit(stage).alias("stage"), message.alias("message"), F.lit(recoverable).alias("recoverable"))).cast(_ERROR)
    return df.withColumn("errors", F.when(when, F.concat(errors, one)).otherwise(errors))


def has_errors(df: DataFrame) -> Column:
    """Whether a row has an error; false where no stage ever added one."""
    return F.size("errors") > 0 if "errors" in df.columns else F.lit(False)


def stages(o: ChunkOptions = DEFAULTS, title: str = "title", source: Column | None = None) -> dict[str, Stage]:
    """The stages of a run by name, in order, each from rows to rows."""
    return {
        "validate": require("doc_id", "text"),
        "parse": parse.parsed,
        "split": lambda d: parse.split_blocks(d, o),
        "pack": pack_stage(o),
        "overlap": lambda d: overlap.add_overlap(d, o),
        "normalize": normalize.normalize_chunks,
        "metadata": lambda d: metadata.attach_metadata(d, title, source),
        "embed": lambda d: embed.add_embed_text(d, o),
        "guardrails": lambda d: guardrails.validate(d, o),
    }


def pack_stage(o: ChunkOptions) -> Stage:
    if o.ranks_file is None:
        return lambda df: pack.pack_arrays(df, "blocks", o)
    return lambda df: _pack_counted(df, o)


def _pack_counted(docs: DataFrame, o: ChunkOptions) -> DataFrame:
    """Packing with exact counts: chunk starts from Arrow, the rest as in ``pack_arrays``."""

    @F.pandas_udf("array<int>")
    def at(texts: pd.Series) -> pd.Series:
        count = K.counter(o.ranks_file)
        return texts.map(lambda t: pack.starts_with_counter(list(t), o, count))

    at = at.asNondeterministic()  # else the optimiser moves the call into a lambda, where Python can't run
    own = [c for c in docs.columns if c != "blocks"]
    rows = docs.withColumn("_at", at(F.transform("blocks", lambda b: b["text"])))
    rows = rows.select(*own, F.posexplode(pack.chunk_arrays(F.col("blocks"), F.col("_at"))).alias("chunk_no", "_b"))
    b = F.col("_b")
    rows = rows.withColumn("content", F.array_join(F.transform(b, lambda x: x["text"]), pack.SEPARATOR))
    return rows.select(
        *own, "chunk_no", "content", K.bpe(F.col("content"), o.ranks_file).alias("tokens"), F.size(b).alias("node_count"),
        F.array_distinct(F.transform(b, lambda x: x["type"])).alias("types"), b[0]["trail"].alias("trail"), b[0]["depths"].alias("depths"),
    )


def chunks(docs: DataFrame, o: ChunkOptions = DEFAULTS, title: str = "title") -> DataFrame:
    """All chunks of Markdown documents, with metadata, embedding text and violations."""
    rows = docs if title in docs.columns else docs.withColumn(title, F.lit(None).cast("string"))
    keep = [c for c in ("doc_id", title, "source_file") if c in rows.columns]
    source = F.col("source_file") if "source_file" in keep else None
    first, *rest = stages(o, title, source).values()
    return flow(first, lambda d: d.where("text is not null").select(*keep, "text"), *rest)(rows)


def full(docs: DataFrame, o: ChunkOptions = DEFAULTS, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """(chunks, statistics by document); documents without a chunk have zeros."""
    c = chunks(docs, o, title)
    return c, stats.compute_stats(c, o, documents=docs)


def analyze_only(docs: DataFrame) -> DataFrame:
    """Structure of the documents; nothing is chunked."""
    return A.analyze(docs)
