"""Operator 5: benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised: characters are decomposed (NFKD, without marks), so
composed and decomposed forms of a letter agree, letters and digits go in lower case, anything
else is a space, runs of spaces one. A document holds an item where ``WINDOW`` words in a row of both
agree; an item of fewer words must be there as a whole. Each window of an item, that is any ``WINDOW`` of its words
in a row, holds an anchor: the rarest of its runs of ``ANCHOR`` words among all items. The anchors of all
items make one automaton. Texts are normalised the same way, a slice of documents at a time with
NumPy, and the automaton reads each slice once. Where it meets an anchor, text and item are compared
word by word to both sides, which gives the longest common run; its windows are the hits. The
positions that survive normalisation are the map by which a hit gets its offsets in the
original text (characters, end exclusive). Hits of one item that touch or overlap are one span.

Items shorter than ``SHORTEST`` words are searched and reported like the others, with n_words telling their
length, but ``clean`` removes no document for them, as they occur in ordinary prose.

The automaton travels to the executors as a broadcast of the items, so their size is checked: it
holds some 4 characters for each character of an item, and items of over ``PART_CHARS`` characters in all
(a thousand times the test tables, more than all public test sets together) are divided into
parts that are scanned for in turn, with the same result.

Defined results: null, empty and wordless texts and items match nothing; a text that repeats a
window has a span for each place; repeated items give the same spans under each item_id; ties
between equally rare anchors go to the first; very long texts are read whole, a slice of rows at
a time; rows without an id keep a null id; items without an id are left out; an empty table gives
an empty result (documents) or leaves all documents (benchmark); further columns are ignored,
and kept by ``clean``.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, ANCHOR, SHORTEST, PART_CHARS = 13, 4, 5, 10_000_000
_SCHEMA = "doc_id bigint, item_id bigint, start int, end int, n_windows int, n_words int"
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
_built: dict[str, "Items"] = {}


def normal(c: str) -> str:
    """What a character becomes: nothing (a mark), letters and digits in lower case, or a space."""
    out = ""
    for x in unicodedata.normalize("NFKD", c).lower():
        for y in unicodedata.normalize("NFKD", x):
            out += "" if unicodedata.combining(y) else y if y.isalnum() else " "
    return out


def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many characters each code point becomes, where these begin, all of them on end)."""
    global _tables
    if _tables is None:
        size, flat = np.ones(0x110000, np.int8), np.full(0x110000, 32, np.uint32)
        start, more = np.arange(0x110000, dtype=np.int32), []
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0x323B0 <= c < 0xE0000 or c >= 0xE01F0:
                continue  # surrogates, private use and what isn't assigned: spaces
            ch = chr(c)
            if unicodedata.is_normalized("NFKD", ch) and not unicodedata.combining(ch):
                if ch.isalnum():
                    low = ch.lower()
                    if len(low) == 1 and unicodedata.is_normalized("NFKD", low):
                        flat[c] = ord(low)
                        continue
                else:
                    continue
            out = normal(ch)
            size[c], start[c] = len(out), len(flat) + len(more)
            more += map(ord, out)
        _tables = size, start, np.concatenate([flat, np.array(more, np.uint32)])
    return _tables


def normalised(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, (position in the joined input of each of its characters, begin of each text there).

    Texts are kept apart by a character that no normalised text has.
    """
    joined = "\n" + "\n\n\n".join(t or "" for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([1, *(len(t or "") + 3 for t in texts)])
    size, start, flat = letters()
    n = size[codes]
    if (n == 1).all():
        out, at = flat[start[codes]], np.arange(len(codes))
    else:
        at = np.repeat(np.arange(len(codes)), n)
        out = flat[start[codes[at]] + np.arange(len(at)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)]
    out = out.copy()
    out[np.searchsorted(at, begin[1:-1] - 2)] = 1
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep].tobytes().decode("utf-32-le", "surrogatepass"), at[keep], begin


def words(text: str | None) -> list[str]:
    return normalised([text])[0].split()


class Items:
    """Benchmark items as words, and one automaton over their anchors."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids, self.words = [], []
        for item, text in items:
            if w := words(text):
                self.ids.append(item)
                self.words.append(w)
        seen: Counter[str] = Counter()
        grams = []
        for w in self.words:
            g = min(ANCHOR, len(w))
            grams.append([" ".join(w[j : j + g]) for j in range(len(w) - g + 1)])
            seen.update(set(grams[-1]))
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (w, gs) in enumerate(zip(self.words, grams)):
            span = min(WINDOW, len(w)) - min(ANCHOR, len(w)) + 1  # anchors within a window
            rank = [(seen[x], -len(x), j) for j, x in enumerate(gs)]
            for j in {min(rank[i : i + span])[2] for i in range(len(gs) - span + 1)}:
                at[gs[j]].append((k, j))
        self.automaton = ahocorasick.Automaton()
        for x, places in at.items():
            self.automaton.add_word(f" {x} ", (len(x) + 2, tuple(places)))
        if at:
            self.automaton.make_automaton()

    def __bool__(self) -> bool:
        return bool(self.ids)


def _items(key: str, items: list[tuple[int, str | None]]) -> Items:
    if key not in _built:
        _built.clear()
        _built[key] = Items(items)
    return _built[key]


def _common(text: str, start: int, end: int, w: list[str], j: int, n: int) -> tuple[list[tuple[int, int]], int]:
    """Places in ``text`` of the words of the longest run equal to words of ``w``, and the run's first word there.

    The words from ``j`` to ``n`` are known to be at ``start`` to ``end``.
    """
    places, at = [], start
    for x in w[j:n]:
        places.append((at, at + len(x)))
        at += len(x) + 1
    a, before = start - 1, []
    while j and text.endswith(x := " " + w[j - 1], 0, a) and a - len(x) >= 0:
        before.append((a - len(x) + 1, a))
        a, j = a - len(x), j - 1
    while n < len(w) and text.startswith(x := w[n] + " ", end + 1):
        places.append((end + 1, end + len(x)))
        end, n = end + len(x), n + 1
    return before[::-1] + places, j


def spans(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, start, end, windows, words of the item) of all hits in ``texts``."""
    if not items:
        return []
    text, at, begin = normalised(texts)
    hits: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    done: dict[tuple[int, int], int] = {}  # (item, where its first word would be): end of the last run compared there
    for last, (length, places) in items.automaton.iter(text):
        start = last - length + 2
        for k, j in places:
            w = items.words[k]
            diagonal = (k, start - sum(map(len, w[:j])) - j)
            if done.get(diagonal, -1) >= last:
                continue
            run, _ = _common(text, start, last, w, j, j + min(ANCHOR, len(w)))
            done[diagonal] = run[-1][1]
            size = min(WINDOW, len(w))
            if len(run) >= size:
                row = int(np.searchsorted(begin, at[run[0][0]], side="right")) - 1
                hits[row, k].update((run[i][0], run[i + size - 1][1]) for i in range(len(run) - size + 1))
    out = []
    for (row, k), found in hits.items():
        places = sorted((int(at[a] - begin[row]), int(at[b - 1] - begin[row]) + 1) for a, b in found)
        start, end, n = *places[0], 0
        more = (items.ids[k], len(items.words[k]))
        for a, b in places:
            if a > end:
                out.append((row, more[0], start, end, n, more[1]))
                start, end, n = a, b, 0
            end, n = max(end, b), n + 1
        out.append((row, more[0], start, end, n, more[1]))
    return out


def _parts(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in parts of about PART_CHARS characters."""
    few = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = few.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // PART_CHARS) or 1
    for k in range(n):
        part = few if n == 1 else few.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def _find(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _items(key, shared.value)
        for b in C.slices(batches, "text"):
            found = spans(a, b.column("text").to_pylist())
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), *(pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32())))],
                ["doc_id", "item_id", "start", "end", "n_windows", "n_words"],
            )

    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, n_windows, n_words): a row for each span of a document that an item covers; the item's words."""
    few = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in _parts(items):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        found = few.mapInArrow(_find(uuid.uuid4().hex, shared), _SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def _clean(key: str, shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _items(key, shared.value)
        for b in C.slices(batches, "text"):
            keep = np.ones(b.num_rows, bool)
            keep[[s[0] for s in spans(a, b.column("text").to_pylist()) if s[5] >= SHORTEST]] = False
            yield b.select(columns).filter(pa.array(keep))

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item of ``SHORTEST`` words or more, all columns kept."""
    docs = C.with_text(docs)
    for part in _parts(items):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        docs = docs.mapInArrow(_clean(uuid.uuid4().hex, shared, docs.columns), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
