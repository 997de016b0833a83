"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Digits to which scores are compared.
DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of length zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def search(vectors: DataFrame, query: list[float], k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors; one scan, each partition sends its best ``k``."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_, cosine(F.col(vector), q).alias("score")).where("score is not null").orderBy(F.desc("score"), id_).limit(k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm[:, None] > 0, m / norm[:, None], np.nan)


#: Scores of a tile, which a task holds at once: queries by vectors.
_TILE = (256, 2048)


def _few(k: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (row, score, id) the best ``k`` of each row, sorted."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    order = order[keep]
    return row[keep], score[order], ids[order]


class Best:
    """The best ``k`` vectors of each of ``q``, unit vectors, as vectors stream past: tiles of scores, few entries for each query."""

    def __init__(self, k: int, q: np.ndarray) -> None:
        self.k, self.q = k, q
        n = range(0, len(q), _TILE[0])
        self.low = [np.full(min(_TILE[0], len(q) - i), -np.inf) for i in n]
        self.kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in n]

    def add(self, v: np.ndarray, ids: np.ndarray) -> None:
        for a in range(0, len(v), _TILE[1]):
            part, own = v[a : a + _TILE[1]].T, ids[a : a + _TILE[1]]
            for t, low in enumerate(self.low):
                raw = self.q[t * _TILE[0] : t * _TILE[0] + len(low)] @ part
                # what rounding may lift to the last place is let through
                near = raw >= low[:, None]
                if raw.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(low):
                    low = np.maximum(low, np.partition(raw, -self.k, axis=1)[:, -self.k] - 2 * 10.0**-DIGITS)
                    near = raw >= low[:, None]
                row, at = np.nonzero(near)
                if not len(row):
                    continue
                old = self.kept[t]
                new = np.r_[old[0], row], np.r_[old[1], np.round(raw[row, at], DIGITS)], np.r_[old[2], own[at]]
                self.kept[t] = row, score, _ = _few(self.k, *new)
                last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
                low[row[last]] = np.maximum(low[row[last]], score[last] - 2 * 10.0**-DIGITS)
                self.low[t] = low


def _best(k: int, shared):
    """For each query, the best ``k`` vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for b in batches:
            size = np.asarray(pc.list_value_length(b.column("v")))
            for d, (_, q) in shared.value.items():
                rows = np.flatnonzero(size == d)
                step = max(1, (8 << 20) // (8 * d))  # vectors of 8 MB at once
                for a in range(0, len(rows), step):
                    some = pa.array(rows[a : a + step])
                    v = _unit(np.asarray(b.column("v").take(some).flatten(), np.float64).reshape(len(some), d))
                    ok = ~np.isnan(v).any(axis=1)
                    best.setdefault(d, Best(k, q)).add(v[ok], np.asarray(b.column("id").take(some))[ok])
        for d, found in best.items():
            for t, (row, score, ids) in enumerate(found.kept):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][row + t * _TILE[0]]), pa.array(ids), pa.array(score)], ["query_id", "id", "score"])

    return run


def _by_dimension(q: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, by dimension; those without a direction match nothing and are left out."""
    t = q.toArrow().combine_chunks()
    ids, v = np.asarray(t.column("id").cast(pa.int64())), t.column("v")
    size = np.asarray(pc.list_value_length(v))
    out = {}
    for d in set(size.tolist()) - {0}:
        rows = np.flatnonzero(size == d)
        unit = _unit(np.asarray(v.take(pa.array(rows)).combine_chunks().flatten(), np.float64).reshape(len(rows), d))
        ok = ~np.isnan(unit).any(axis=1)
        if ok.any():
            out[d] = ids[rows][ok], unit[ok]
    return out


def _sound(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    sound = F.col(id_).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    return rows.where(sound).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", most: int = 64 << 20) -> DataFrame:
    """(query_id, id, score, rank) for a table of queries (query_id, query).

    Each pair is compared, which no index avoids when exact. The queries are broadcast, in as many parts as keep
    each under ``most`` bytes, and the vectors stream past them without a shuffle: one scan for each part. A task
    holds a tile of scores at a time and sends its best ``k`` for each query.
    Scores that agree to DIGITS digits are ties, ordered by id. Rows without an id or with a null
    in the vector are ignored; vectors of length zero and of another dimension match nothing.
    """
    spark = vectors.sparkSession
    q, v = _sound(queries, "query_id", "query"), _sound(vectors, id_, vector)
    parts = -(-8 * (q.agg(F.sum(F.size("v"))).first()[0] or 0) // most) or 1
    few = None
    for p in range(parts):
        some = q if parts == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        shared = spark.sparkContext.broadcast(_by_dimension(some))
        found = v.mapInArrow(_best(k, shared), "query_id bigint, id bigint, score double")
        few = found if few is None else few.unionAll(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
