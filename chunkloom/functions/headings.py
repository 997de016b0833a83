"""Heading text, slugs and node types from text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: (pattern, replacement) in order: markers, links, code, bold, italic, strike-through.
MARKUP = [
    (rf"\A#+{X.WHITE}*", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"~~([^~]+)~~", "$1"),
]


def clean(c: Column) -> Column:
    for pattern, to in MARKUP:
        c = F.regexp_replace(c, pattern, to)
    return X.trim(c)


def first_heading(c: Column) -> Column:
    """First line, trimmed, that begins with #; empty without one."""
    found = F.filter(F.transform(F.split(c, "\n"), X.trim), lambda x: F.startswith(x, F.lit("#")))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def slug_base(c: Column) -> Column:
    """Lower case, letters, digits, spaces, - and _ only, each space a dash."""
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))


class Slugs:
    """Slugs of one document's cleaned headings, in the order in which they are asked for.

    Equal headings share a slug; other headings with an equal base get -1, -2 and so on, past any
    slug that is already taken.
    """

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.of: dict[str, str] = {}

    def slug(self, heading: str, base: str) -> str:
        if heading not in self.of:
            slug, n = base, self.seen.get(base, 0)
            while slug in self.seen:
                n += 1
                slug = f"{base}-{n}"
            self.seen[base] = n
            self.seen.setdefault(slug, 0)
            self.of[heading] = slug
        return self.of[heading]


def running_slugs(place: Column, headings: Column) -> Column:
    """Slugs of each row's cleaned headings; a document begins where ``place`` is 1.

    Rows must come document by document in order, as a window leaves them; what is known of a
    document is kept from row to row.
    """

    @F.pandas_udf("array<string>")
    def assign(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Slugs()
        for places, texts, bases in batches:
            out = []
            for at, hs, bs in zip(places, texts, bases):
                if at == 1:
                    known = Slugs()
                out.append([known.slug(h, b) for h, b in zip(hs, bs)] if hs is not None else None)
            yield pd.Series(out, index=places.index, dtype=object)

    return assign.asNondeterministic()(place, headings, F.transform(headings, slug_base))


def sniffed_types(c: Column) -> Column:
    """Node types guessed from marks in the text; a paragraph always comes last."""
    has = lambda s: F.contains(c, F.lit(s))
    return F.array_compact(
        F.array(
            F.when(has("#"), "heading"),
            F.when(has("```"), "code"),
            F.when(has("- ") | has("* ") | c.rlike(r"(?:\A|[\n\r\u2028\u2029])[0-9]+\."), "list-item"),
            F.when(has("|"), "table"),
            F.when(has(">"), "blockquote"),
            F.lit("paragraph"),
        )
    )
