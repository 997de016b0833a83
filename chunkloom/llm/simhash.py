"""Operator 10: SimHash near-duplicates through segment popcounts.

A document's fingerprint has 256 bits: each distinct word, hashed to one of 2**16 buckets,
adds its bucket's sign vector with weight 1 + log2(count); a bit is a sum's sign. Fingerprints
are cut into 128 segments of two bits, and a segment is represented by its number of ones.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so it rejects pairs before the exact test. No pair within the limit is left out:
the fingerprint is cut into 33 pieces, one more than the limit of 32 bits, so such a pair agrees
in a piece at least. Moreover (cycle lemma) there is a piece from which on, in a circle, every run
of k pieces differs in k - 1 bits at most. Fingerprints that agree in a piece share a cell, and
within a cell the pairs are compared whose next two pieces differ in one bit and two bits at most
and the eight pieces in seven (``piece_edges``). Manhattan distance, then Hamming distance,
decide. Equal fingerprints are merged before, so copies cost nothing.

Counts are stored as sorted segments (00, 01, 11): Manhattan distance is then the number of
ones of an XOR, as Hamming distance is.

Shuffled rows are 33 a fingerprint at every size. Compared pairs grow with the square of the number
of fingerprints: in the check tables 0.013 of all pairs pass the first three pieces, at some 15 ns each.

Cells are counted exactly, and one of over ``HOT`` fingerprints is divided into blocks; each pair
of blocks is a group of its own, so every pair of the cell still meets, in tasks of bounded size.
Within a cell only components are kept, not pairs, so memory follows the cell's fingerprints.

Near duplicates are the connected components of pairs within the limit. One row of each stays:
the one with the least doc_id (null ids last), of repeated rows the first. Rows are told apart
by their place in the input (partition and position), so ``docs`` must give the same rows in
the same order whenever it is read, as a table does. Cells yield a spanning forest of their
verified pairs, not the pairs, so a group of m near copies gives some m edges and not m * m / 2.

Defined results: null, empty and wordless texts have no fingerprint and are no duplicates, so
all their rows stay; repeated rows and rows with a null id are rows like any other, and exactly
one row of a group stays (``near_duplicates`` names documents by id, so groups of null ids and
repeated rows of one id have no row there, and an id that has both a duplicate and another text
does); ties in doc_id are settled by place; very long texts are hashed in blocks of words; an
empty table gives an empty result; further columns are ignored, and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS, LIMIT, CELLS = 256, 32, 12
#: Fingerprints in a cell from which it is divided into blocks.
HOT = 200_000
#: Fingerprints, about, whose cell entries one task writes: a row becomes 33, and a task holds and sorts them before it spills.
TASK = 16_384
#: Bytes of text and pairs of fingerprints that a worker takes at once; it keeps most of what it once took.
_TEXT, _PAIRS = 1 << 20, 1 << 16
_FP = ["f0", "f1", "f2", "f3"]
_FP_SCHEMA = "row bigint, doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"
#: Cells up to the first size are compared together, pair by pair; up to the second all pairs' heads are compared, beyond it those of like pieces.
#: This is for speed only: all three find every pair.
_PAIRWISE, _DIRECT = 48, 512
_signs: np.ndarray | None = None


# What a join by equality in grids would need and miss; no query uses it any more.


def meeting(distance: int, cells: int = CELLS) -> float:
    """Probability that a pair at this Hamming distance shares a cell of one grid."""
    q = distance / BITS
    return ((1 - q) ** 2 + q * q / 2) ** cells


def tables_for(cells: int = CELLS, limit: int = LIMIT, recall: float = 0.91) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(limit, cells)))


def cells_for(n: int) -> int:
    """Segments of a cell for ``n`` distinct fingerprints."""
    return CELLS + max(0, math.ceil(math.log(max(n, 1) / 1e7) / -math.log(0.375)))


def signs() -> np.ndarray:
    """Sign vectors of the word buckets, -1 and 1; the same in every process."""
    global _signs
    if _signs is None:
        n, words, some = 1 << C.BUCKET_BITS, BITS // 64, 1 << 12
        table = np.empty((n, BITS), np.int8)
        for a in range(0, n, some):
            h = C.mix(np.arange(a * words + 1, (a + some) * words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            table[a : a + some] = (np.unpackbits(h.view(np.uint8)).reshape(some, BITS).astype(np.int8) * 2) - 1
        _signs = table
    return _signs


def fingerprint_array(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as n x 4 uint64, has words) of each text."""
    rows, bucket, count = C.word_buckets(text)
    weight = (1 + np.log2(count)).astype(np.float32)
    table = signs()
    total = np.zeros((len(text), BITS), np.float32)
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)]):
        for c in range(a, b, 8192):
            d = min(b, c + 8192)
            total[rows[a]] += weight[c:d] @ table[bucket[c:d]].astype(np.float32)
    some = np.zeros(len(text), bool)
    some[rows[start]] = True
    return np.packbits(total > 0, axis=1).view(np.uint64), some


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.slices(batches, "text", _TEXT):
        fp, some = fingerprint_array(b.column("text"))
        keep = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [b.column("row").filter(keep), b.column("doc_id").filter(keep), *(pa.array(fp[some, k].view(np.int64)) for k in range(4))], ["row", "doc_id", *_FP]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, f0..f3): place, id and fingerprint of each row that has a word."""
    few = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_fingerprint_batches, _FP_SCHEMA)


def sorted_segments(x: np.ndarray) -> np.ndarray:
    """Each two-bit segment as its count of ones: 0 -> 00, 1 -> 01, 2 -> 11."""
    m = np.uint64(0x5555555555555555)
    y = x >> np.uint64(1)
    return ((x & y & m) << np.uint64(1)) | ((x | y) & m)


@lru_cache(16)
def pieces(limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of ``limit`` + 1 disjoint pieces, none across two words, of eight bits at most."""
    out = []
    for w in range(4):
        n = (limit + 1 + w) // 4
        edges = [64 * i // n for i in range(n + 1)] if n else []
        out += [(w, a, min(8, b - a)) for a, b in zip(edges, edges[1:])]
    return out


def cell_entries(reps: DataFrame, limit: int = LIMIT, tasks: int | None = None) -> DataFrame:
    """A row for each fingerprint and piece: the cell (piece * 256 + the piece's bits), and the fingerprint. ``tasks``: made in so many."""
    if tasks:
        reps = reps.repartition(tasks, "rep")
    keys = (f"{256 * k}L + (shiftrightunsigned({_FP[w]}, {a}) & {(1 << n) - 1}L)" for k, (w, a, n) in enumerate(pieces(limit)))
    return reps.selectExpr(f"explode(array({', '.join(keys)})) AS cell", "rep", *_FP)


def near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of a and b (fingerprints, then their sorted segments) are within ``limit``: Manhattan bound, then exact."""
    low = np.bitwise_count(a[..., 4:] ^ b[..., 4:]).sum(axis=-1, dtype=np.int32) <= limit
    out = np.zeros(low.shape, bool)
    at = np.nonzero(low)
    a, b = np.broadcast_to(a, (*low.shape, 8)), np.broadcast_to(b, (*low.shape, 8))
    out[at] = np.bitwise_count(a[at][:, :4] ^ b[at][:, :4]).sum(axis=-1, dtype=np.int32) <= limit
    return out


def cell_edges(cell: np.ndarray, ids: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair within ``limit`` of whole cells that lie together; rows of a cell are consecutive."""
    fp = np.hstack([fp, sorted_segments(fp)])
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, len(cell)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size[size > 1]).tolist():
        first = start[size == m]
        step = max(1, _PAIRS // (m * m))
        rows = max(1, _PAIRS // m)  # of a cell at once
        for k in range(0, len(first), step):
            for r in range(0, m, rows):
                i, j = np.triu_indices(min(rows, m - r), 1, m - r)
                part = first[k : k + step, None] + r
                x, y = (part + i).ravel(), (part + j).ravel()
                ok = near(fp[x], fp[y], limit)
                left.append(ids[x[ok]])
                right.append(ids[y[ok]])
    return np.concatenate(left), np.concatenate(right)


@lru_cache(64)
def _flips(one: int, two: int) -> np.ndarray:
    """Masks over two pieces on end, not 0: one bit at most in the first, two bits in all."""
    low, high = [1 << i for i in range(one)], [1 << (one + i) for i in range(two)]
    return np.array([*low, *high, *(x | y for x in low for y in high), *(x | y for k, x in enumerate(high) for y in high[:k])], np.int64)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1 and so on, count[k] numbers for each k, on end."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + count, count)


def _parts(weight: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive entries that weigh about ``most``, or of one entry."""
    edges = np.cumsum(weight) // most
    cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(weight)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def piece_edges(ids: np.ndarray, fp: np.ndarray, piece: int, limit: int, direct: int = _DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) of each component of fingerprints that agree in ``piece``, over all pairs within ``limit`` that
    differ in k - 1 bits at most in each run of k pieces from this one on."""
    n, cut = len(ids), pieces(limit)
    run = [cut[(piece + k) % len(cut)] for k in range(min(8, len(cut)))]
    head, at = np.zeros(n, np.uint64), 0
    for w, a, b in run:
        head |= ((fp[:, w] >> np.uint64(a)) & np.uint64((1 << b) - 1)) << np.uint64(at)
        at += b
    label = np.arange(n)

    def join(i: np.ndarray, j: np.ndarray) -> None:
        """Components of rows i and j, whose heads are alike, become one where a pair is within the limit."""
        nonlocal label
        for s in range(0, len(i), _PAIRS):
            x, y = i[s : s + _PAIRS], j[s : s + _PAIRS]
            open_ = label[x] != label[y]
            x, y = x[open_], y[open_]
            a, b = fp[x], fp[y]
            ok = near(np.hstack([a, sorted_segments(a)]), np.hstack([b, sorted_segments(b)]), limit)
            if ok.any():
                least, other = stars(label[x[ok]], label[y[ok]])
                to = np.arange(n)
                to[other] = least
                label = to[label]

    alike = lambda x, y: np.bitwise_count(x ^ y) < len(run)
    if n <= direct or len(run) < 3:
        step = max(1, (1 << 19) // max(n, 1))
        for k in range(0, n, step):
            i, j = np.nonzero(alike(head[k : k + step, None], head[None, k:]))
            join(i[i < j] + k, j[i < j] + k)
        other = np.flatnonzero(label != np.arange(n))
        return ids[label[other]], ids[other]

    # buckets of rows whose next two pieces agree, and pairs of buckets that differ in few bits there
    bits = run[1][2] + run[2][2]
    rest = ((head >> np.uint64(run[0][2])) & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(rest, kind="stable")
    ids, fp, head, rest = ids[order], fp[order], head[order], rest[order]
    start = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    size = np.diff(np.r_[start, n])
    value, own = rest[start], np.arange(len(start))
    place = np.full(1 << bits, -1)
    place[value] = own

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        """All pairs of a row of bucket p and one of q; first those of first rows of large buckets, as then one component may hold both."""
        big = size[p] * size[q] > 64
        if big.any():
            x = _ranges(start[p[big]], np.where(p == q, size[p], 1)[big])
            y = np.repeat(start[q[big]], np.where(p == q, size[p], 1)[big])
            ok = alike(head[x], head[y])
            join(x[ok], y[ok])
            low, high = np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)
            open_ = (low[p] != high[p]) | (low[q] != high[q]) | (low[p] != low[q])
            p, q = p[open_], q[open_]
        for s in _parts(size[p], 1 << 18):
            i, to = _ranges(start[p[s]], size[p[s]]), np.repeat(q[s], size[p[s]])
            first = np.where(np.repeat(p[s], size[p[s]]) == to, i + 1, start[to])
            count = start[to] + size[to] - first
            for r in _parts(count, 1 << 18):
                y = _ranges(first[r], count[r])
                ok = np.flatnonzero(alike(np.repeat(head[i[r]], count[r]), head[y]))
                join(np.repeat(i[r], count[r])[ok], y[ok])

    many = own[size > 1]
    for s in _parts(size[many] ** 2, 1 << 22):
        compare(many[s], many[s])
    flips = _flips(run[1][2], run[2][2])
    for k in range(0, len(own), 2048):
        q = place[value[k : k + 2048, None] ^ flips]
        p, c = np.nonzero(q > own[k : k + 2048, None])
        compare(p + k, q[p, c])
    other = np.flatnonzero(label != np.arange(n))
    return ids[label[other]], ids[other]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, node) for each other node of the components of these edges: as few edges as will do."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(ids))
    return ids[label[other]], ids[other]


def _edge_batches(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts: list[tuple]) -> pa.RecordBatch:
            cell, ids, fp = (np.concatenate(x) for x in zip(*parts))
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[start, len(cell)])
            few = np.repeat(size <= _PAIRWISE, size)
            edges = [cell_edges(cell[few], ids[few], fp[few], limit)] if few.any() else []
            for s, m in zip(start[size > _PAIRWISE].tolist(), size[size > _PAIRWISE].tolist()):
                edges.append(piece_edges(ids[s : s + m], fp[s : s + m], int(cell[s] & 0xFFFF) >> 8, limit))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*edges)))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(n)) for n in ("cell", "rep", *_FP)]
            part = (cols[0], cols[1], np.stack([c.view(np.uint64) for c in cols[2:]], 1))
            new = np.flatnonzero(part[0] != part[0][-1])
            cut = int(new[-1]) + 1 if len(new) else 0  # the last cell may go on in the next batch
            if held and held[-1][0][-1] != part[0][0]:
                yield out(held)
                held = []
            if cut:
                yield out([*held, tuple(x[:cut] for x in part)])
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield out(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node of the connected component of each node of ``edges`` (a < b).

    Alternates large-star and small-star steps until nothing changes; each round is written to
    the shared folder. The number of rounds grows with the logarithm of the largest component.
    """
    now = C.written(edges.distinct(), "edges")
    mark = None
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        before, now = now, C.written(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        C.delete(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("least")).unionAll(now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("least")))
        mark = tuple(new)


def divided(entries: DataFrame, hot: int = HOT) -> DataFrame:
    """``entries`` with each cell of over ``hot`` rows divided into blocks, a key for each pair of blocks. A key's low 16 bits are the cell."""
    found = entries.groupBy("cell").count().where(F.col("count") > hot).collect()
    if not found:
        return entries
    parts = [(r[0], -(-2 * r[1] // hot)) for r in found]
    blocks = F.broadcast(entries.sparkSession.createDataFrame(parts, "hot bigint, blocks bigint"))
    rows = entries.join(blocks, F.col("cell") == F.col("hot"), "left").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: j != F.col("own"))
    pairs = F.transform(others, lambda j: F.col("cell") + 65536 * (1 + F.least("own", j) * F.col("blocks") + F.greatest("own", j)))
    keys = F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(pairs)
    return rows.select(F.explode(keys).alias("cell"), "rep", *_FP)


def links(reps: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: edges between fingerprints (rep, f0..f3) whose components are those of all pairs within ``limit``."""
    n = reps.count()
    entries = cell_entries(reps, limit, 1 + n // TASK)
    if n > hot:  # else no cell has more
        entries = divided(entries, hot)
    return entries.repartition("cell").sortWithinPartitions("cell").mapInArrow(_edge_batches(limit), "a bigint, b bigint")


def grouped(docs: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(row, doc_id, kept_row, duplicate_of, group_size) of each row in a group of more than one."""
    fps = C.written(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    reps = C.written(fps.groupBy(*_FP).agg(F.min("row").alias("rep"), first.alias("best"), F.count(F.lit(1)).alias("n")), "reps")
    of = components(links(reps, limit, hot))
    member = reps.join(of, reps.rep == of.node, "left").select(*_FP, F.coalesce("least", "rep").alias("g"), "best", "n")
    groups = member.groupBy("g").agg(F.min("best").alias("kept"), F.sum("n").alias("group_size")).where("group_size > 1")
    rows = fps.join(member.select(*_FP, "g").join(groups, "g"), _FP)
    return rows.select("row", "doc_id", F.col("kept.row").alias("kept_row"), F.col("kept.doc_id").alias("duplicate_of"), "group_size")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, duplicate_of, group_size): each document that goes, the one that stays for it, and the rows in their group."""
    gone = grouped(docs, **options).where("row <> kept_row and doc_id <> duplicate_of")
    least = F.min(F.struct("duplicate_of", "group_size"))
    return gone.groupBy("doc_id").agg(least.alias("d")).select("doc_id", "d.duplicate_of", "d.group_size")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept."""
    place = C.unused(docs, "_row")
    gone = grouped(docs, **options).where("row <> kept_row").select(F.col("row").alias(place))
    return docs.withColumn(place, F.monotonically_increasing_id()).join(gone, place, "left_anti").select(*docs.columns)


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
