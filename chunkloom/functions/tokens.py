"""Token counts: the length heuristics as column expressions, byte-pair encoding through Arrow.

The heuristic needs lengths only, so packing under it is integer arithmetic inside the JVM. The
encoder counts exactly; it is loaded once for each Python worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow as A
from . import text as X

PER_TOKEN = 3.8
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def of_length(n: Column) -> Column:
    """Tokens of a text of ``n`` characters: none for no character, else at least one."""
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(PER_TOKEN)).cast("int")))


def heuristic(c: Column) -> Column:
    return of_length(X.length(c))


def at_least_one(c: Column) -> Column:
    """Older rule: an empty text counts as one token."""
    return F.greatest(F.lit(1), F.floor(X.length(c) / F.lit(PER_TOKEN)).cast("int"))


def quarter(c: Column, least: int = 0) -> Column:
    """Characters (code points) by four, rounded down."""
    return F.greatest(F.lit(least), F.floor(F.length(c) / 4).cast("int"))


def estimated(n: Column) -> Column:
    """Estimate for a text of ``n`` characters, rounded up."""
    return F.ceil(n / F.lit(PER_TOKEN)).cast("int")


def count_heuristic(s: str) -> int:
    return count_of_length(X.units(s))


def count_of_length(n: int) -> int:
    """``of_length`` of one number."""
    return max(1, int(n / PER_TOKEN)) if n else 0


def most_units(max_tokens: int) -> int:
    """The greatest length whose count is at most ``max_tokens``; -1 where none is."""
    n = max(int((max_tokens + 2) * PER_TOKEN), 0)
    while n >= 0 and count_of_length(n) > max_tokens:
        n -= 1
    return n


def encoder(ranks_file: str):
    if ranks_file not in _encoders:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encoders[ranks_file] = tiktoken.Encoding(os.path.basename(ranks_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_file]


def counter(ranks_file: str | None) -> Callable[[str], int]:
    """A Python token counter: exact with a file of ranks, else the heuristic."""
    if ranks_file is None:
        return count_heuristic
    return lambda s: len(encoder(ranks_file).encode_ordinary(s))


def bpe(c: Column, ranks_file: str) -> Column:
    """Exact token count with the byte-pair vocabulary in ``ranks_file``."""
    return A.each(c, lambda t: len(encoder(ranks_file).encode_ordinary(t)), "int")


def count(c: Column, ranks_file: str | None) -> Column:
    return bpe(c, ranks_file) if ranks_file else heuristic(c)
