"""Older splitters, packer and filters, kept beside the current ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X
from ..functions import tokens as K

#: (max, target, overlap sentences) of the two older chunkers.
JS_OPTIONS, PY_OPTIONS = (400, 200, 1), (800, 400, 1)
SYMBOLS = r"(?m)(?=^\s*(?:def|class|function|export|const|let|var) )"


def heading_parts(c: Column) -> Column:
    """Cut before each heading line, without taking anything away; blank parts are dropped."""
    return X.not_blank(F.split(X.trim(c), r"(?m)(?=^#{1,6}\s)"))


def paragraph_parts(c: Column) -> Column:
    return X.not_blank(F.split(X.trim(c), r"\n{2,}"))


def symbol_parts(c: Column) -> Column:
    """Cut before lines that begin a definition."""
    return X.not_blank(F.split(X.trim(c), SYMBOLS))


_SENTENCE = re.compile(r"(?<=\S[.!?])\s+(?=[A-Z0-9\"'(])")
_CODE = re.compile(r"(```.*?```)", re.S)


def code_aware_sentences(text: str) -> list[str]:
    """Sentences; fenced code stays whole."""
    out = []
    for i, part in enumerate(_CODE.split(text)):
        if i % 2:
            out.append(part)
        else:
            out += [s.strip() for s in _SENTENCE.split(part) if s.strip()]
    return out


def sentence_parts(c: Column) -> Column:
    return A.each(c, code_aware_sentences, "array<string>")


def cut_additive(t: str, max_tokens: int) -> list[str]:
    """``additive_cut`` of one text."""
    length, out, cur, n = X.counter(t), [], [], 0
    for w in re.split(r"[ \t\n\x0b\f\r]+", t):
        k = int((length(w) + 1) / K.PER_TOKEN) or 1
        if n + k > max_tokens and cur:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(w)
        n += k
    return [*out, " ".join(cur)]


def additive_cut(c: Column, max_tokens: int) -> Column:
    """Greedy cut at words by the sum of the words' own counts, each with a space."""
    return A.each(c, lambda t: cut_additive(t, max_tokens), "array<string>")


def ladder(text: str, structure: str, max_tokens: int, count: Callable[[str], int] = lambda s: max(1, int(len(s) / K.PER_TOKEN))) -> list[str]:
    """Rules of a structure (markdown, code, plain) in turn; after the first that cuts, only parts that are too large go on."""
    cut = lambda pattern: lambda t: [p for p in re.split(pattern, t.strip()) if p.strip()]
    heads, paras, symbols = cut(r"(?m)(?=^#{1,6}\s)"), cut(r"\n{2,}"), cut(SYMBOLS)
    rules = {"markdown": [heads, paras, code_aware_sentences], "code": [symbols, paras, code_aware_sentences], "plain": [paras, code_aware_sentences]}[structure]

    def words(t: str) -> list[str]:
        out, cur, n = [], [], 0
        for w in re.split(r"\s+", t):
            k = count(w + " ")
            if cur and n + k > max_tokens:
                out.append(" ".join(cur).strip())
                cur, n = [], 0
            cur.append(w)
            n += k
        return [*out, " ".join(cur).strip()] if cur else out

    def go(t: str, k: int) -> list[str]:
        if k == len(rules):
            return words(t)
        parts = rules[k](t)
        if len(parts) == 1:
            return go(t, k + 1) if count(t) > max_tokens else [t]
        return [q for p in parts for q in (go(p, k + 1) if count(p) > max_tokens else [p])]

    return go(text, 0)


def ladder_parts(c: Column, structure: str, max_tokens: int) -> Column:
    return A.each(c, lambda t: ladder(t, structure, max_tokens), "array<string>")


def additive_starts(counts: Column, max_tokens: int) -> Column:
    """First piece of each chunk: pieces join while the sum of their counts allows it; separators are ignored."""
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, t: Column) -> Column:
        new = (s["i"] == 0) | (s["n"] + t > max_tokens)
        return F.struct((s["i"] + 1).alias("i"), F.when(new, t).otherwise(s["n"] + t).alias("n"), F.when(new, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"))

    return F.aggregate(counts, init, step, lambda s: s["at"])


def cumulative_overlap(contents: Column, sentences: int) -> Column:
    """Each chunk gets the last sentences of the chunk before it as that one already is."""

    def run(cs: list[str | None]) -> list[str | None]:
        out, tail = [], None
        for i, x in enumerate(cs):
            # without sentences to take there is nothing but a blank; after a null all is null
            new = x if not i else None if x is None or tail is None else f"{tail} {x}"
            tail = None if new is None else " ".join(X.last_sentences(new, sentences))
            out.append(new)
        return out

    return A.each(contents, run, "array<string>")


_MARKUP = [(r"(?m)^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|```.*$)", ""), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"`([^`]+)`", r"\1"), (r"(\*\*|__|~~)(.+?)\1", r"\2"), (r"\*([^*]+)\*", r"\1")]


def without_marks(text: str) -> str:
    """A text as it is counted against the least size: without Markdown's marks."""
    for pattern, to in _MARKUP:
        text = re.sub(pattern, to, text)
    return text.strip()


SEPARATORS = ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n\n", "\n", ". ", "! ", "? ", " ", ""]


def recursive_characters(text: str, size: int = 625, overlap: int = 100, least: int = 50, count: Callable[[str], int] = lambda s: len(s) // 4) -> list[str]:
    """Recursive split by a list of separators that stay at the begin of what follows; neighbours are merged up to ``size``; parts under ``least`` without their marks are left out."""

    def cut(t: str, seps: list[str]) -> list[str]:
        sep = next((s for s in seps if s == "" or s in t), "")
        rest = seps[seps.index(sep) + 1 :]
        if sep:
            raw = t.split(sep)
            pieces = [raw[0], *(sep + x for x in raw[1:])]
        else:
            pieces = list(t)
        out, good = [], []
        for p in (x for x in pieces if x):
            if count(p) <= size:
                good.append(p)
                continue
            out += merge(good)
            good = []
            out += cut(p, rest) if rest else [p]
        return out + merge(good)

    def merge(pieces: list[str]) -> list[str]:
        out, cur, n = [], [], 0
        for p in pieces:
            k = count(p)
            if cur and n + k > size:
                out.append("".join(cur))
                while cur and (n > overlap or (n + k > size and n > 0)):
                    n -= count(cur.pop(0))
            cur.append(p)
            n += k
        return out + (["".join(cur)] if cur else [])

    return [s for s in (x.strip() for x in cut(text, SEPARATORS)) if count(without_marks(s)) >= least]


def recursive_parts(c: Column, size: int = 625, overlap: int = 100) -> Column:
    return A.each(c, lambda t: recursive_characters(t, size, overlap), "array<string>")


#: Rules of dashes, bare # signs, marks of emphasis, an open fence.
_MARKS = r"-+|#+\s*|\s*[`*_-]+\s*|```\s*"


def low_quality(c: Column) -> Column:
    """Short without a heading, marks only, or a short piece of code or script."""
    t = X.trim(c)
    n = F.length(t)
    return ((n < 100) & ~t.rlike(r"\A#+\s+\w")) | t.rlike(rf"\A(?:{_MARKS})\z") | ((n < 200) & t.rlike(r"(?s)\A(?:```.*```|<script.*</script>)\z"))


_USELESS = r"(?s)\A(?:-+|=+|#+\s*|\s*[`*_-]+\s*|```.*```|\s*\|\s*\|\s*|\s*>\s*|\s*[0-9]+\.\s*|\s*[-*+]\s*)\z"


def useless(c: Column) -> Column:
    """Under 50 characters, one of nine patterns, or under three words without marks."""
    t = X.trim(c)
    words = F.filter(F.split(F.regexp_replace(t, r"[#*_`>\-=|]", ""), r"\s+"), lambda w: w != "")
    return (F.length(t) < 50) | t.rlike(_USELESS) | (F.size(words) < 3)


def trivial(c: Column) -> Column:
    return F.length(X.trim(c)) <= 10


def title_prefixed(title: Column, section: Column, body: Column) -> Column:
    """Title and section lines before the body, and the SHA-256 of the whole."""
    return F.concat(F.lit("Title: "), title, F.when(section != "", F.concat(F.lit("\nSection: "), section)).otherwise(F.lit("")), F.lit("\n\n"), body)


def pack_pieces(docs: DataFrame, pieces: str, max_tokens: int) -> DataFrame:
    """(.., chunk_no, content, n_pieces) from an array of texts."""
    counts = F.transform(F.col(pieces), K.at_least_one)
    own = [c for c in docs.columns if c != pieces]
    rows = docs.withColumn("_at", additive_starts(counts, max_tokens))
    from .pack import chunk_arrays

    rows = rows.select(*own, F.posexplode(chunk_arrays(F.col(pieces), F.col("_at"))).alias("chunk_no", "_p"))
    return rows.select(*own, "chunk_no", F.array_join("_p", "\n\n").alias("content"), F.size("_p").alias("n_pieces"))
