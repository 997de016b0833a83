"""Column functions with the string semantics of ECMAScript: trim, length, rounding, splitting.

Spark's ``trim`` strips spaces only, ``\\s`` is ASCII, ``length`` counts code points and ``round``
goes away from zero; the functions here follow the language the chunking rules were written for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a Java regular expression class.
WHITE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same for RE2, which the SQL twins run on.
WHITE_RE2 = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same for Python.
WHITE_PY = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Its characters.
WHITES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and stands once in the plan, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITES))


def length(c: Column) -> Column:
    """Number of UTF-16 units, as int."""
    units = (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(units)  # ASCII needs no encoding


def half_up(c: Column) -> Column:
    """Rounded to an integer, halves towards +infinity."""
    return F.floor(c + F.lit(0.5))


def round2(c: Column) -> Column:
    return F.floor(c * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.rlike(f"[^{WHITE[1:]}"))


def sentences(c: Column) -> Column:
    """Split at white space after . ! or ?; the whole text where nothing else is left."""
    parts = not_blank(F.split(c, rf"(?<=[.!?]){WHITE}+"))
    return let(parts, lambda p: F.when(F.size(p) > 0, p).when(c.isNotNull(), F.array(c)))


def lines(c: Column) -> Column:
    return not_blank(F.split(c, "\n"))


def paragraphs(c: Column) -> Column:
    return not_blank(F.split(c, "\n\n"))


# --- the same for Python, inside Arrow batches

_SENTENCE_END = re.compile(rf"[.!?]({WHITE_PY}+)")


def units(s: str) -> int:
    """Number of UTF-16 units."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def counter(s: str) -> Callable[[str], int]:
    """``units`` for parts of ``s``: plain ``len`` where all its characters have one unit."""
    return len if units(s) == len(s) else units


def cut_sentences(s: str) -> list[str]:
    """``sentences`` of one text."""
    out, at = [], 0
    for m in _SENTENCE_END.finditer(s):
        i, j = m.span(1)
        out.append(s[at:i])
        at = j
    out.append(s[at:])
    return [p for p in out if p.strip(WHITES)] or [s]


def last_sentences(s: str, n: int) -> list[str]:
    return cut_sentences(s)[-n:] if n > 0 else []


def shortened(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)
