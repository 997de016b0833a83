"""White space normalisation, as column expressions over the array of a text's lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X

_FENCE = rf"\A{X.WHITE}*```"


def strip_line_ends(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, rf"{X.WHITE}+\z", "")), "\n")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"\n{X.WHITE}*\n{X.WHITE}*\n+", "\n\n")


def fenced(lines: Column) -> Column:
    """For each line a struct of the line, whether it is a fence and whether it lies in a fenced block."""
    init = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line:string,fence:boolean,inside:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fence = F.coalesce(x.rlike(_FENCE), F.lit(False))
        row = F.struct(x.alias("line"), fence.alias("fence"), (s["inside"] & ~fence).alias("inside"))
        return F.struct((s["inside"] != fence).alias("inside"), F.concat(s["out"], F.array(row)).alias("out"))

    marked = lambda ls: F.aggregate(ls, init, step, lambda s: s["out"])
    plain = lambda ls: F.transform(ls, lambda x: F.struct(x.alias("line"), F.lit(False).alias("fence"), F.lit(False).alias("inside")))
    # the fold copies its array at each line; texts without a fence don't need it
    return X.let(lines, lambda ls: F.when(F.exists(ls, lambda x: x.rlike(_FENCE)), marked(ls)).otherwise(plain(ls)))


def _free(m: Column) -> Column:
    """A line that may be changed: no fence, not inside one, not blank."""
    return ~m["fence"] & ~m["inside"] & (F.length(X.trim(m["line"])) > 0)


def collapse_inner_spaces(c: Column) -> Column:
    marked = fenced(F.split(c, "\n"))
    return F.array_join(F.transform(marked, lambda m: F.when(_free(m), F.regexp_replace(m["line"], X.WHITE + "+", " ")).otherwise(m["line"])), "\n")


def dedent(c: Column) -> Column:
    """Takes the least indent of the free lines from each of them."""
    indent = lambda x: F.length(F.regexp_extract(x, rf"\A({X.WHITE}*)", 1))
    least = lambda ms: F.coalesce(F.array_min(F.transform(F.filter(ms, _free), lambda m: indent(m["line"]))), F.lit(0))
    cut = lambda ms, n: F.array_join(F.transform(ms, lambda m: F.when(_free(m), F.substr(m["line"], n + 1)).otherwise(m["line"])), "\n")
    return X.let(fenced(F.split(c, "\n")), lambda ms: X.let(least(ms), lambda n: cut(ms, n)))


_BLANK_LINES, _RUN, _LEAD = re.compile(rf"\n{X.WHITE_PY}*\n{X.WHITE_PY}*\n+"), re.compile(f"{X.WHITE_PY}+"), re.compile(f"{X.WHITE_PY}*")


def _free_lines(lines: list[str]) -> list[int]:
    """Places of the lines that may be changed, as ``_free``."""
    out, inside = [], False
    for i, x in enumerate(lines):
        t = x.lstrip(X.WHITES)
        if t.startswith("```"):
            inside = not inside
        elif t and not inside:
            out.append(i)
    return out


def normalized(t: str) -> str:
    """``normalize`` of one text."""
    t = "\n".join([x.rstrip(X.WHITES) for x in t.split("\n")])
    lines = _BLANK_LINES.sub("\n\n", t).split("\n")
    free = _free_lines(lines)
    for i in free:
        lines[i] = _RUN.sub(" ", lines[i])
    n = min((_LEAD.match(lines[i]).end() for i in free), default=0)
    if n:
        for i in free:
            lines[i] = lines[i][n:]
    return "\n".join(lines).strip(X.WHITES)


def normalize(c: Column) -> Column:
    """Line ends, blank lines, inner spaces, indents and ends of a text, in one pass over its lines."""
    return F.coalesce(A.each(c, normalized, "string"), F.lit(""))


def normalize_chunks(chunks: DataFrame) -> DataFrame:
    """Changes content only; token counts stay."""
    return chunks.withColumn("content", normalize(F.col("content")))
