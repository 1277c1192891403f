"""Exact top-k inner-product search with multi-resolution segment statistics.

For a segment of L components with means m and deviations s, two vectors' parts
are at least ``L * ((m_q - m_c)^2 + (s_q - s_c)^2)`` apart (squared). Summed over
segments this bounds the distance from below, and with the norms the inner
product from above: ``(|q|^2 + |c|^2 - bound) / 2``. Resolutions go from coarse
to fine; only pairs whose bound still reaches the query's k-th best score go on,
and survivors get the exact integer score.

Queries are dealt out in blocks of about ``BLOCK`` rows, candidates in slices. Each
block meets each slice in one task, by a shuffle on the two numbers: the block comes
first and is held, the slice streams past in bounded pieces, and k rows per query
go on. Nothing passes through the driver but row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

BLOCK = 8192
#: Candidates in a slice: at least, so that a block is worth sending, and at most.
LEAST_SLICE, MOST_SLICE = 4096, 1 << 22
#: Segments per resolution; a vector shorter than that has one per component.
RESOLUTIONS = (1, 4, 16)
#: Candidates and queries compared at once.
ROWS, FRONT = 4096, 1024
#: Share of pairs left under which these are scored one by one.
SPARSE = 0.05
#: Score and id of what isn't a pair; their negatives are whole numbers, too.
NO_SCORE, NO_ID = -(1 << 62), np.iinfo(np.int64).max


def quantize(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): floor(256 * x) of each component, x as double, and a number
    that tells rows apart. Rows whose vector is null or holds null or non-finite
    components, or whose vec_id is null, are left out; rows that share a vec_id are
    rows of their own. A vector of norm 2^31 or more is an error, as its scores might
    not be whole numbers of 64 bits. Store the result: row numbers are given anew
    whenever it is computed."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    scaled = F.transform(x, lambda e: F.floor(e * 256))
    square = F.aggregate(x, F.lit(0.0), lambda s, e: s + (F.abs(e) * 256 + 1) * (F.abs(e) * 256 + 1))
    small = F.when(square < float(1 << 62), scaled).otherwise(F.raise_error(F.concat(F.lit("components too large for whole scores: vec_id "), F.col("vec_id").cast("string"))).cast("array<bigint>"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", small.alias("v"))


class _Vectors:
    """Vectors of one length with their statistics at each resolution."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.rows, self.ids, self.v = rows, ids, v
        x = v.astype(np.float64)
        self.square = (x * x).sum(1)
        n = v.shape[1]
        self.levels = []
        for parts in RESOLUTIONS if n else ():
            edge = np.unique(np.linspace(0, n, min(parts, n) + 1).astype(np.int64))
            size = np.diff(edge)
            mean = np.add.reduceat(x, edge[:-1], axis=1) / size
            spread = np.sqrt(np.maximum(np.add.reduceat(x * x, edge[:-1], axis=1) / size - mean * mean, 0))
            self.levels.append(np.concatenate([mean, spread], axis=1) * np.sqrt(np.tile(size, 2)))

    def take(self, rows: np.ndarray | slice) -> _Vectors:
        out = object.__new__(_Vectors)
        out.rows, out.ids, out.v, out.square = self.rows[rows], self.ids[rows], self.v[rows], self.square[rows]
        out.levels = [x[rows] for x in self.levels]
        return out


def _by_length(rows: np.ndarray, ids: np.ndarray, flat: np.ndarray, size: np.ndarray) -> dict[int, _Vectors]:
    start = np.cumsum(size) - size
    return {int(n): _Vectors(rows[size == n], ids[size == n], flat[start[size == n][:, None] + np.arange(n)[None, :]]) for n in np.unique(size)}


def _exact(q: np.ndarray, c: np.ndarray, square: float) -> np.ndarray:
    """Integer inner products of all pairs of rows; in doubles where these are exact."""
    if square < 2**53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Best:
    """The k best (score, then least id) so far for each query of a block."""

    def __init__(self, queries: _Vectors, k: int):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.score = np.full((n, k), NO_SCORE)
        self.ids = np.full((n, k), NO_ID)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores [rows, candidates]; entries that aren't pairs have the least score and greatest id."""
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.ids[rows], ids], axis=1)
        if s.shape[1] > 4 * self.k:
            # Ties at the k-th place are kept for the sort by id.
            kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
            width = int((s >= kth[:, None]).sum(1).max())
            near = np.argpartition(-s, min(width, s.shape[1] - 1), axis=1)[:, :width] if width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            s, i = np.take_along_axis(s, near, 1), np.take_along_axis(i, near, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def search(self, c: _Vectors) -> None:
        for at in range(0, len(self.q.ids), FRONT):
            self._front(np.arange(at, min(at + FRONT, len(self.q.ids))), c)

    def _front(self, rows: np.ndarray, c: _Vectors) -> None:
        square = float(np.sqrt(self.q.square[rows].max() * c.square.max()))
        slack = 1 + 1e-9 * square
        alive = self.q.rows[rows][:, None] != c.rows
        for level in range(len(c.levels)):
            q = self.q.take(rows)
            bound = np.where(alive, self._bound(q, c, q.levels[level], c.levels[level]), -np.inf)
            # The candidates of highest bound give the threshold that the others must reach.
            for _ in range(min(self.k, len(c.ids))):
                first = bound.argmax(1)
                real = np.flatnonzero(bound[np.arange(len(rows)), first] > -np.inf)
                self._score_pairs(rows, c, real, first[real])
                bound[real, first[real]], alive[real, first[real]] = -np.inf, False
            alive &= bound >= self.score[rows, -1].astype(np.float64)[:, None] - slack
            keep_q, keep_c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(keep_q):
                return
            if len(keep_c) < 0.7 * len(c.ids) or len(keep_q) < 0.7 * len(rows):
                c, rows, alive = c.take(keep_c), rows[keep_q], alive[np.ix_(keep_q, keep_c)]
        if alive.mean() < SPARSE:
            # Few pairs are left: these alone, the n-th of each query at a time.
            i, j = np.nonzero(alive)
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            for n in range(int(nth.max(initial=-1)) + 1):
                self._score_pairs(rows, c, i[nth == n], j[nth == n])
        else:
            score = _exact(self.q.v[rows], c.v, square)
            self.add(rows, np.where(alive, score, NO_SCORE), np.where(alive, c.ids, NO_ID))

    def _score_pairs(self, rows: np.ndarray, c: _Vectors, i: np.ndarray, j: np.ndarray) -> None:
        """Exact scores of the pairs rows[i], c[j]; an i comes once at most."""
        if len(i):
            self.add(rows[i], np.einsum("ij,ij->i", self.q.v[rows[i]], c.v[j])[:, None], c.ids[j][:, None])

    @staticmethod
    def _bound(q: _Vectors, c: _Vectors, ql: np.ndarray, cl: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products: from the lower bounds of the distances."""
        distance = (ql * ql).sum(1)[:, None] + (cl * cl).sum(1)[None, :] - 2 * (ql @ cl.T)
        return (q.square[:, None] + c.square[None, :] - distance) / 2


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = batch.column(batch.schema.get_field_index("v"))
    named = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("row", "vec_id")]
    return *named, v.flatten().to_numpy(), v.value_lengths().to_numpy()


def search(candidates: DataFrame, queries: DataFrame, *, k: int) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the k highest inner products of each
    row of ``queries`` with the other rows of ``candidates`` (row, vec_id, v), both
    stored beforehand; ties go to the smaller vec_id. Only vectors of the same length
    are compared."""
    spark = candidates.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    n, tasks = candidates.count(), 2 * spark.sparkContext.defaultParallelism
    slices = max(1, min(-(-n // LEAST_SLICE), max(-(-tasks // blocks), -(-n // MOST_SLICE))))
    number = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = queries.select(number(blocks).alias("block"), every(slices).alias("slice"), F.lit(0).alias("side"), "row", "vec_id", "v")
    held = candidates.select(every(blocks).alias("block"), number(slices).alias("slice"), F.lit(1).alias("side"), "row", "vec_id", "v")
    dealt = asked.unionByName(held).repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "side")
    found = dealt.mapInArrow(_task(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def _task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            for b in (best or {}).values():
                real = b.ids != NO_ID
                own = [np.broadcast_to(x[:, None], real.shape)[real] for x in (b.q.rows, b.q.ids)]
                yield pa.record_batch([*map(pa.array, own), pa.array(b.ids[real]), pa.array(b.score[real])], names=["query_row", "query_id", "vec_id", "score"])

        for part in _runs(batches):
            key = tuple(part.column(i)[0].as_py() for i in range(2))
            if key != now:
                yield from done()
                now, waiting, best = key, [], None
            if part.column(2)[0].as_py() == 0:
                waiting.append(part)
                continue
            if best is None:
                block = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if waiting else None
                best = {n: Best(v, k) for n, v in _by_length(*_columns(block)).items()} if block else {}
            for n, c in _by_length(*_columns(part)).items():
                if n in best:
                    best[n].search(c)
        yield from done()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows of one block, slice and side."""
    for batch in batches:
        if batch.num_rows:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:]):
                for at in range(a, b, ROWS):
                    yield batch.slice(at, min(ROWS, b - at))


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the ``k`` best other rows for each
    row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``;
    fewer, if there are fewer. A table without usable vectors gives no rows."""
    made = stored(quantize(vectors), "topk-vectors")
    return search(made, made.filter(F.col("vec_id") % every == 0), k=k)


#: ``top_k`` with its defaults in DuckDB SQL, for vectors of one length.
TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
