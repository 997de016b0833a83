"""Ids, links, offsets, header paths, slugs and derived fields of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrow as A
from ..functions import headings as H
from ..functions import text as X
from ..functions import tokens as K
from .overlap import document

VERSION = "1.0.0"
#: Types of the columns that ``attach_metadata`` adds, for documentation and schema checks.
KNOWN = ["contentType", "sectionTitle", "headerPath", "fileTitle", "headerBreadcrumb", "headerDepths", "headerSlugs", "sectionSlug", "sourceFile", "nodeTypes"]


def chunk_id(parent: Column, number: Column) -> Column:
    return F.concat(parent, F.lit("::ch"), number.cast("string"))


def links(chunks: DataFrame, parent: Column, key: str = "doc_id") -> DataFrame:
    """Adds id, parent_id, prev_id and next_id; the ends of the chain are null."""
    w = document(key)
    rows = chunks.withColumn("id", chunk_id(parent, F.col("chunk_no"))).withColumn("parent_id", F.split_part("id", F.lit("::"), F.lit(1)))
    return rows.withColumn("prev_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


def offsets(chunks: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Adds char_start, char_end and total_chars: running sums of the chunks' lengths."""
    w = document(key)
    n = X.length(F.col(content))
    rows = chunks.withColumn("_n", n)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("char_start", before).withColumn("total_chars", F.sum("_n").over(Window.partitionBy(key)))
    return rows.withColumn("char_end", F.col("char_start") + F.col("_n")).drop("_n")


def header_path(trail: Column, content: Column) -> Column:
    own = H.first_heading(content)
    return F.when(F.coalesce(F.size(trail), F.lit(0)) > 0, trail).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))


def header_depths(depths: Column, path: Column) -> Column:
    counted = F.when(F.size(path) > 0, F.sequence(F.lit(1), F.size(path))).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(F.size(depths), F.lit(0)) > 0, depths).otherwise(counted)


def with_slugs(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds header_slugs; a document's headings are numbered in the order of its chunks, in one pass over them."""
    rows = chunks.withColumn("_place", F.row_number().over(document(key)))
    return rows.withColumn("header_slugs", H.running_slugs(F.col("_place"), F.transform("header_path", H.clean))).drop("_place")


def attach_metadata(chunks: DataFrame, title: str = "title", source_file: Column | None = None, key: str = "doc_id") -> DataFrame:
    """All metadata of chunk rows (doc_id, chunk_no, content, tokens, types, trail, depths, title).

    Ids hold the document's source file, so they differ between documents; without a source file
    it is made of the key. Offsets and estimates are taken from the content before it is trimmed.
    """
    file = F.coalesce(source_file if source_file is not None else F.lit(None).cast("string"), F.concat(F.col(key).cast("string"), F.lit(".md")))
    rows = chunks.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("source_file", file)
    rows = links(rows, F.concat(F.lit("doc:"), F.col("source_file")), key)
    rows = offsets(rows, key)
    rows = rows.withColumn("header_path", header_path(F.col("trail"), F.col("content")))
    rows = rows.withColumn("header_depths", header_depths(F.col("depths"), F.col("header_path")))
    rows = with_slugs(rows, key)
    last = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(-1)), F.lit(""))
    return rows.select(
        "*",
        F.when(F.coalesce(F.size("types"), F.lit(0)) > 0, F.col("types")).otherwise(H.sniffed_types(F.col("content"))).alias("node_types"),
        F.array_join("header_path", " > ").alias("header_breadcrumb"),
        last("header_path").alias("section_title"),
        last("header_slugs").alias("section_slug"),
        K.estimated(X.length(F.col("content"))).alias("estimated_tokens"),
        F.when(F.coalesce(F.col(title), F.lit("")) == "", "untitled").otherwise(F.col(title)).alias("file_title"),
        X.trim(F.col("content")).alias("original_text"),
        F.lit("doc").alias("content_type"),
        F.lit(VERSION).alias("pipeline_version"),
    ).withColumn("tokens", F.when(F.coalesce(F.col("tokens"), F.lit(0)) != 0, F.col("tokens")).otherwise(K.heuristic(F.col("content"))))


def char_offsets(full: Column, part: Column) -> tuple[Column, Column, Column]:
    """(start, end, confidence) of a part of a text: exact, by its first 100 characters, or not found."""
    exact, near = F.instr(full, part), F.instr(full, F.substring(part, 1, 100))
    start = F.when(exact > 0, exact - 1).when(near > 0, near - 1).otherwise(-1)
    return start, F.when(start >= 0, start + F.length(part)).otherwise(-1), F.when(exact > 0, 1.0).when(near > 0, 0.8).otherwise(0.0)


def _placed(parts: list[str], full: str | None) -> list[dict]:
    out = []
    for p in parts:
        # where the first characters are not, the whole is not either, nor is it before them
        near = -1 if full is None else full.find(p[:100])
        exact = full.find(p, near) if near >= 0 else -1
        start = exact if exact >= 0 else near
        out.append({"char_start": start, "char_end": start + len(p) if start >= 0 else -1, "confidence": 1.0 if exact >= 0 else 0.8 if near >= 0 else 0.0})
    return out


def all_char_offsets(full: Column, parts: Column) -> Column:
    """``char_offsets`` of all parts of a text, which is then there once and not beside each of them."""
    return A.each(parts, _placed, "array<struct<char_start:int,char_end:int,confidence:double>>", full)


_HEADER = rf"\A(#{{1,6}}){X.WHITE}+([^\n\r\u2028\u2029]+)\z"


def _headers(text: Column) -> Column:
    """Header lines of a text: (line, level, text, full)."""
    at = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), X.trim(x).alias("full")))
    found = F.filter(at, lambda h: h["full"].rlike(_HEADER))
    return F.transform(found, lambda h: F.struct(h["line"].alias("line"), F.length(F.regexp_extract(h["full"], _HEADER, 1)).alias("level"), F.regexp_extract(h["full"], _HEADER, 2).alias("text"), h["full"].alias("full")))


def header_hierarchy(full: Column, part: Column) -> Column:
    """(header_path, hierarchy) of a part by its place in the text: the open headers there, then its own one if deeper.

    Null without a part, empty where the part is not found.
    """
    start = F.instr(full, X.trim(part))
    before = F.size(F.split(F.substring(full, F.lit(1), start - 1), "\n"))
    empty = F.filter(_headers(F.lit("")), lambda h: F.lit(False))
    push = lambda stack, h: F.concat(F.filter(stack, lambda x: x["level"] < h["level"]), F.array(h))
    open_ = F.aggregate(F.filter(_headers(full), lambda h: h["line"] < before), empty, push)
    own = F.slice(_headers(part), 1, 1)
    deeper = lambda st: F.when((F.size(own) > 0) & ((F.size(st) == 0) | (own[0]["level"] > F.element_at(st, -1)["level"])), F.concat(st, own)).otherwise(st)
    path = X.let(F.when(start > 0, open_).otherwise(empty), lambda st: F.when(start > 0, deeper(st)).otherwise(st))
    return X.let(path, lambda p: F.struct(F.transform(p, lambda h: h["full"]).alias("header_path"), F.array_join(F.transform(p, lambda h: h["text"]), " > ").alias("hierarchy")))
