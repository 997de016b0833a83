"""Checks of chunks. Lenient: a column of violations. Strict: the job fails at the first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrow as A
from ..functions import text as X
from ..plans.options import DEFAULTS, ChunkOptions

CODES = ["EMPTY_CONTENT", "TOO_SHORT", "TOO_LONG", "FORMATTING_ONLY", "EMPTY_HEADER", "ORPHANED_CODE"]
PROSE = 200
_W = X.WHITE_PY
_INNER = _W[1:-1]
_END = r"\n\r\u2028\u2029"

_MARKS = re.compile(rf"#{{1,6}}{_W}*|-{{3,}}|`{{3,}}|[*_\-{_INNER}]*|[|{_INNER}]*|[>{_INNER}]*")
_BARE_HEADER, _HEADER = re.compile(rf"#{{1,6}}{_W}*\Z"), re.compile(rf"#{{1,6}}{_W}+[^{_END}]+")
_BLOCK, _INLINE = re.compile(r"(?s)```.*?```"), re.compile(r"`[^`]+`")
# white space at the begin of a line that leads to no mark is gone through once, and stays
_AT_LINE = [re.compile(rf"(?:(?<=[{_END}])|\A)(?:{_W}*{mark}|({_W}+))") for mark in (rf"#{{1,6}}{_W}*[^{_END}]*", rf"[-*+]{_W}+", rf">{_W}+")]


def is_empty(c: str) -> bool:
    return not c.strip(X.WHITES)


def formatting_only(c: str) -> bool:
    return bool(_MARKS.fullmatch(c.strip(X.WHITES)))


def empty_header(c: str) -> bool:
    first, more, rest = c.partition("\n")
    first = first.strip(X.WHITES)
    return bool(_BARE_HEADER.match(first) or (more and not rest.strip(X.WHITES) and _HEADER.match(first)))


def orphaned_code(c: str, prose: int = PROSE) -> bool:
    if "`" not in c or not (_BLOCK.search(c) or _INLINE.search(c)):
        return False
    rest = _INLINE.sub("", _BLOCK.sub("", c))
    for mark in _AT_LINE:
        rest = mark.sub(lambda m: m[1] or "", rest)
    return X.units(rest.strip(X.WHITES)) < prose


def faults(content: Column) -> Column:
    """What is wrong with a text by itself, as bits: empty, marks only, header without content, code without prose."""
    tests = (is_empty, formatting_only, empty_header, orphaned_code)
    return A.each(content, lambda c: sum(f(c) << i for i, f in enumerate(tests)), "int")


def violations(bits: Column, tokens: Column, single: Column, o: ChunkOptions = DEFAULTS) -> Column:
    """Codes of what is wrong with a chunk, in a fixed order, from its ``faults``."""
    bit = lambda i: F.getbit(bits, F.lit(i)) == 1
    tests = [bit(0), ~single & (tokens < o.min_tokens), tokens > o.max_tokens, bit(1), bit(2), bit(3)]
    return F.array_compact(F.array(*(F.when(t, F.lit(code)) for t, code in zip(tests, CODES))))


def messages(codes: Column, tokens: Column, o: ChunkOptions = DEFAULTS) -> Column:
    text = {
        "EMPTY_CONTENT": F.lit("Chunk has no text"),
        "TOO_SHORT": F.concat(F.lit("Chunk has "), tokens.cast("string"), F.lit(f" tokens, fewer than {o.min_tokens}")),
        "TOO_LONG": F.concat(F.lit("Chunk has "), tokens.cast("string"), F.lit(f" tokens, more than {o.max_tokens}")),
        "FORMATTING_ONLY": F.lit("Chunk has markup but no text"),
        "EMPTY_HEADER": F.lit("Chunk has a header without content"),
        "ORPHANED_CODE": F.lit("Chunk has code without explanation"),
    }
    of = lambda code: F.coalesce(*(F.when(code == k, v) for k, v in text.items()))
    return F.transform(codes, lambda code: F.struct(code.alias("code"), of(code).alias("message")))


def validate(chunks: DataFrame, o: ChunkOptions = DEFAULTS, content: str = "original_text", key: str = "doc_id") -> DataFrame:
    """Adds violations and returns every chunk; in strict mode the first violation fails the job."""
    single = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    codes = violations(F.col("_faults"), F.coalesce(F.col("tokens"), F.lit(0)), F.col("_single"), o)
    # before the window, so the text need not be shuffled for it
    rows = chunks.withColumn("_faults", faults(F.coalesce(F.col(content), F.lit(""))))
    rows = rows.withColumn("_single", single).withColumn("violations", messages(codes, F.coalesce(F.col("tokens"), F.lit(0)), o)).drop("_single", "_faults")
    if o.strict:
        first = F.get("violations", F.lit(0))
        failed = F.raise_error(F.concat(F.lit("chunk validation failed: "), first["code"], F.lit(": "), first["message"]))
        rows = rows.withColumn("violations", F.when(F.size("violations") > 0, failed.cast(rows.schema["violations"].dataType)).otherwise(F.col("violations")))
    return rows
