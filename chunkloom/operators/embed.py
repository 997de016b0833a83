"""Text for embedding: the chunk's text, with its place in the document where it needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.options import DEFAULTS, ChunkOptions

LONGEST = 160


def truncated(c: Column, longest: int = LONGEST) -> Column:
    side = (longest - 1) // 2
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.left(c, F.lit(side)), F.lit("…"), F.right(c, F.lit(side))))


def full_breadcrumb(title: Column, breadcrumb: Column, path: Column) -> Column:
    return (
        F.when(title.eqNullSafe(F.get(path, F.lit(0))), breadcrumb)
        .when(breadcrumb != "", F.concat(title, F.lit(" > "), breadcrumb))
        .otherwise(title)
    )


def starts_with_heading(text: Column, title: Column) -> Column:
    """Text begins with # signs and then the section's title, case aside."""
    t = X.trim(text)
    rest = F.regexp_replace(t, rf"\A#+{X.WHITE}*", "")
    plain = t.rlike(r"\A#") & F.startswith(F.lower(rest), F.lower(title))
    # a title that itself begins with # or white space may take some of the # signs
    marked = F.regexp_like(t, F.concat(F.lit(rf"(?i)\A#+{X.WHITE}*\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.when(title == "", False).when(title.rlike(rf"\A(#|{X.WHITE})"), marked).otherwise(plain)


def needs_full_context(text: Column, types: Column, tokens: Column, min_tokens: int) -> Column:
    bare = (F.size(types) > 0) & F.forall(types, lambda t: t.isin("code", "table", "list-item"))
    return X.trim(text).rlike(rf"\A#+{X.WHITE}") | bare | (tokens < min_tokens)


def embed_text(
    text: Column, title: Column, breadcrumb: Column, path: Column, section: Column, types: Column, tokens: Column, mode: str = "conditional", min_tokens: int = 200
) -> Column:
    if mode == "none":
        return text
    full = full_breadcrumb(title, breadcrumb, path)
    before = lambda c: F.concat(c, F.lit("\n\n"), text)
    whole = F.when(full != "", before(truncated(full))).otherwise(text)
    if mode == "always":
        return F.when(starts_with_heading(text, section), text).otherwise(whole)
    only_title = ~title.eqNullSafe(F.get(path, F.lit(0))) & (title != "")
    return F.when(starts_with_heading(text, section), text).when(needs_full_context(text, types, tokens, min_tokens), whole).when(only_title, before(title)).otherwise(text)


def add_embed_text(chunks: DataFrame, o: ChunkOptions = DEFAULTS) -> DataFrame:
    c = F.col
    return chunks.withColumn(
        "embed_text", embed_text(c("original_text"), c("file_title"), c("header_breadcrumb"), c("header_path"), c("section_title"), c("node_types"), c("tokens"), o.breadcrumb_mode, o.min_tokens)
    )
