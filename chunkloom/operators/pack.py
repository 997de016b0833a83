"""Packing of a document's blocks into chunks.

A buffer takes blocks in order. It closes before a block that would take it over the maximum,
and after a block with which it reaches nine tenths of the maximum, or minimum and target. A
short rest joins the chunk before it if both fit. A document that fits as a whole is one chunk.

Blocks of a document are one array, so packing needs no shuffle. Python workers get lengths only
and give the index of each chunk's first block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X
from ..functions import tokens as K
from ..plans.options import DEFAULTS, ChunkOptions

SEPARATOR = "\n\n"


def starts(lengths: Column, o: ChunkOptions = DEFAULTS) -> Column:
    """Index of the first block of each chunk, from the blocks' lengths."""
    return A.each(lengths, lambda ns: starts_of_lengths(ns, o)[0], "array<int>")


def chunk_arrays(blocks: Column, at: Column) -> Column:
    """The blocks of each chunk, as an array of arrays."""
    return F.transform(at, lambda s, i: F.slice(blocks, s + 1, F.coalesce(F.get(at, i + 1), F.size(blocks)) - s))


def pack_arrays(docs: DataFrame, blocks: str = "blocks", o: ChunkOptions = DEFAULTS) -> DataFrame:
    """A row for each chunk of documents with an array of blocks.

    ``blocks`` holds structs with text, type, trail and depths. Adds chunk_no, content, tokens,
    node_count, types, trail and depths. A rest merged into the last chunk leaves that chunk's
    node count and types as they were, as ``tail`` in the fold is only text by then.
    """
    own = [c for c in docs.columns if c != blocks]
    lengths = F.transform(F.col(blocks), lambda b: X.length(b["text"]))
    cut = docs.withColumn("_at", A.each(lengths, lambda ns: starts_of_lengths(ns, o), "array<array<int>>"))
    chunks = F.arrays_zip(chunk_arrays(F.col(blocks), F.col("_at")[0]).alias("b"), F.col("_at")[1].alias("n"))
    rows = cut.select(*own, F.posexplode(chunks).alias("chunk_no", "_x")).select(*own, "chunk_no", F.col("_x.b").alias("_b"), F.col("_x.n").alias("_n"))
    b = F.col("_b")
    closed = F.slice(b, F.lit(1), F.col("_n"))
    # a step of its own: the count uses the content more than once
    rows = rows.withColumn("content", F.array_join(F.transform(b, lambda x: x["text"]), SEPARATOR))
    return rows.select(
        *own,
        "chunk_no",
        "content",
        K.heuristic(F.col("content")).alias("tokens"),
        F.size(closed).alias("node_count"),
        F.array_distinct(F.transform(closed, lambda x: x["type"])).alias("types"),
        b[0]["trail"].alias("trail"),
        b[0]["depths"].alias("depths"),
    )


def starts_of_lengths(lengths: list[int | None], o: ChunkOptions = DEFAULTS) -> tuple[list[int], list[int]]:
    """Index of the first block of each chunk, from the blocks' lengths, and how many blocks each had when it closed.

    A document with a block of no text (null) has no length, so it is one chunk.
    """
    if not lengths:
        return [], []
    if None in lengths or K.count_of_length(sum(lengths) + 2 * (len(lengths) - 1)) <= o.max_tokens:
        return [0], [len(lengths)]
    most, nearly, at, size, is_open = K.most_units(o.max_tokens), o.max_tokens * 0.9, [], 0, False
    for i, x in enumerate(lengths):
        if is_open and size + 2 + x <= most:
            size += 2 + x
        else:
            at.append(i)
            size = x
        n = K.count_of_length(size)
        is_open = not (n >= nearly or (n >= o.min_tokens and n >= o.pack_target))
    closed = [j - i for i, j in zip(at, [*at[1:], len(lengths)])]
    if is_open and len(at) > 1 and K.count_of_length(size) < o.min_tokens:
        before = sum(lengths[at[-2] : at[-1]]) + 2 * (at[-1] - at[-2] - 1)
        if K.count_of_length(before + 2 + size) <= o.max_tokens:
            at.pop()
            closed.pop()
    return at, closed


def packed_sentences(t: str, o: ChunkOptions = DEFAULTS) -> list[dict]:
    """Chunks of one text whose blocks are its sentences."""
    length = X.counter(t)
    sentences = [s for s in X.cut_sentences(t) if s.strip(X.WHITES)]
    at, closed = starts_of_lengths([length(s) for s in sentences], o)
    whole = [SEPARATOR.join(sentences[i:j]) for i, j in zip(at, [*at[1:], len(sentences)])]
    return [{"content": c, "tokens": K.count_of_length(length(c)), "node_count": n} for c, n in zip(whole, closed)]


def pack_sentences(docs: DataFrame, text: str = "text", o: ChunkOptions = DEFAULTS) -> DataFrame:
    """``pack_arrays`` of texts whose blocks are their sentences, without trail: one pass over each text."""
    own = [c for c in docs.columns if c != text]
    cut = A.each(F.col(text), lambda t: packed_sentences(t, o), "array<struct<content:string,tokens:int,node_count:int>>")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = docs.select(*own, F.posexplode(cut).alias("chunk_no", "_c"))
    return rows.select(*own, "chunk_no", "_c.*", F.array(F.lit("paragraph")).alias("types"), none("string").alias("trail"), none("int").alias("depths"))


def pack_rows(blocks: DataFrame, o: ChunkOptions = DEFAULTS) -> DataFrame:
    """``pack_arrays`` for rows (doc_id, block_no, text, type, trail, depths): one shuffle by doc_id."""
    one = F.struct("block_no", "text", "type", "trail", "depths")
    return pack_arrays(blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("blocks")), "blocks", o)


def starts_with_counter(texts: list[str], o: ChunkOptions, count: Callable[[str], int]) -> list[int]:
    """``starts_of_lengths`` for any token counter: fits are tested on the joined text, as counts don't add up."""
    if not texts:
        return []
    if count(SEPARATOR.join(texts)) <= o.max_tokens:
        return [0]
    at: list[int] = []
    cur: str | None = None
    for i, t in enumerate(texts):
        joined = None if cur is None else cur + SEPARATOR + t
        if joined is not None and count(joined) <= o.max_tokens:
            cur = joined
        else:
            at.append(i)
            cur = t
        n = count(cur)
        if n >= o.max_tokens * 0.9 or (n >= o.min_tokens and n >= o.pack_target):
            cur = None
    if cur is not None and len(at) > 1 and count(cur) < o.min_tokens:
        if count(SEPARATOR.join(texts[at[-2] :])) <= o.max_tokens:
            at.pop()
    return at
