"""Splitting of oversized texts: paragraphs, then sentences, then lines, then words.

A part that a rung makes small enough goes no further, and no part of a lower rung can be split by
a higher one, so four rungs in a row equal a recursion from the top. The cuts run in Python workers:
the heuristic needs lengths only, so the work is in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X
from ..functions import tokens as K


_RUN = re.compile(f"{X.WHITE_PY}+")
#: White space that is no single blank between two words.
_OTHER_RUN = re.compile(f" {X.WHITE_PY}+|[{X.WHITE_PY[1:-1].replace(' ', '')}]{X.WHITE_PY}*")


def cut_words(t: str, most: int) -> list[str]:
    """Greedy cuts between words into parts of at most ``most`` UTF-16 units, rejoined with one space; a word over that stays whole."""
    length = X.counter(t)
    if length is len and t and t[0] not in X.WHITES and t[-1] not in X.WHITES:
        s, out, i = _OTHER_RUN.sub(" ", t), [], 0
        n = len(s)
        while n - i > most:
            j = s.rfind(" ", i, i + most + 1) if most > 0 else -1
            if j < 0 and (j := s.find(" ", i + max(most, 0))) < 0:
                j = n
            out.append(s[i:j])
            i = j + 1
        return [*out, s[i:]] if i < n else out
    out, cur, n = [], [], 0
    for w in _RUN.split(t):
        k = length(w)
        more = n + 1 + k if n else k
        if more <= most:
            if not n:
                cur = []
            cur.append(w)
            n = more
        elif n:
            out.append(" ".join(cur))
            cur, n = [w], k
        else:
            out.append(w)
    return [*out, " ".join(cur)] if n else out or [t]


def hard_cut(c: Column, max_tokens: int) -> Column:
    """Greedy cuts between words, rejoined with one space; a word over the limit stays whole."""
    most = K.most_units(max_tokens)
    return A.each(c, lambda t: cut_words(t, most), "array<string>")


def cut_oversized(t: str, most: int) -> list[str]:
    """``split_counted`` by lengths, of which parts have at most ``most``."""
    length = X.counter(t)
    if length(t) <= most:
        return [t]
    cuts = [lambda s: s.split("\n\n"), X.cut_sentences, lambda s: s.split("\n")]

    def go(s: str, k: int) -> list[str]:
        if length(s) <= most:
            return [s]
        if k == len(cuts):
            return [p.strip(X.WHITES) for p in cut_words(s, most)]
        parts = [p for x in cuts[k](s) if (p := x.strip(X.WHITES))]
        return [q for p in parts for q in go(p, k + 1)] if len(parts) > 1 else go(s, k + 1)

    return [p for p in go(t, 0) if p]


def split_oversized(c: Column, max_tokens: int) -> Column:
    """Parts of a text, each of at most ``max_tokens`` where words allow it; empty parts are dropped."""
    most = K.most_units(max_tokens)
    return A.each(c, lambda t: cut_oversized(t, most), "array<string>")


def split_blocks(docs: DataFrame, max_tokens: int, text: str = "text") -> DataFrame:
    """(doc_id, block_no, text): each document as one block, oversized ones in parts."""
    return docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(split_oversized(F.col(text), max_tokens)).alias("block_no", "text"))


def split_counted(text: str, max_tokens: int, count: Callable[[str], int]) -> list[str]:
    """``split_oversized`` for any token counter."""
    trim = lambda t: re.sub(rf"\A{X.WHITE_PY}+|{X.WHITE_PY}+\Z", "", t)
    cut = lambda pattern: lambda t: [p for p in re.split(pattern, t) if trim(p)]
    rungs = [cut("\n\n"), cut(rf"(?<=[.!?]){X.WHITE_PY}+"), cut("\n")]

    def words(t: str) -> list[str]:
        out, cur = [], ""
        for w in re.split(X.WHITE_PY + "+", t):
            test = f"{cur} {w}" if cur else w
            if count(test) <= max_tokens:
                cur = test
            elif cur:
                out.append(cur)
                cur = w
            else:
                out.append(w)
        return [*out, cur] if cur else out or [t]

    def go(t: str, k: int) -> list[str]:
        if count(t) <= max_tokens:
            return [t]
        if k == len(rungs):
            return [trim(p) for p in words(t)]
        parts = rungs[k](t)
        return [q for p in parts for q in go(trim(p), k + 1)] if len(parts) > 1 else go(t, k + 1)

    return [text] if count(text) <= max_tokens else [p for p in go(text, 0) if p]
