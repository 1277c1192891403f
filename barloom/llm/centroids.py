"""Centroid clustering of integer vectors, the nearest centroid found by the threshold
algorithm.

Per dimension the centroids' values are sorted once. For a vector, each dimension's list
is walked outward from the vector's own value, nearest value first; a centroid met for
the first time gets its exact distance. After each step a centroid not met yet is in
every dimension at least as far as that list's frontier, so the sum of the squared
frontier distances bounds it from below, and the walk stops once that sum strictly
exceeds the best exact distance. All is whole numbers, so ties are exact.

Rounds are Spark jobs over a stored table: tasks assign their vectors and give sums per
centroid, Spark adds them up, and one row per centroid goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored

#: Numbers (vectors times dimensions, or times centroids) that a task works on at once.
CELLS = 1 << 21


def quantize(vectors: DataFrame, *, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double, of the vectors with
    exactly ``dimensions`` components, none null or non-finite; others are left out. Rows
    that share a vec_id, or have none, are rows of their own. A vector so large that a squared
    distance may pass 2^62 is an error."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda s, e: s + (F.abs(e) * scale + 1) * (F.abs(e) * scale + 1))
    whole = F.when(square < float(1 << 60), F.transform(x, lambda e: F.floor(e * scale))).otherwise(F.raise_error(F.concat(F.lit("components too large for whole distances: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))).cast("array<bigint>"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("v"))


class Lists:
    """Centroids with the sorted list of their values in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each row of ``v``, the smaller one in a tie,
        its squared distance, and the exact distances computed in all."""
        n, (k, dims) = len(v), self.centroids.shape
        best, label = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        met = np.zeros((n, k), bool)
        # Below ``down`` and from ``up`` on, the lists aren't walked yet.
        up = np.stack([np.searchsorted(self.values[:, d], v[:, d]) for d in range(dims)], axis=1)
        down, rows, scored, every = up - 1, np.arange(n), 0, np.arange(dims)[None, :]
        while len(rows):
            x, lo, hi = v[rows], down[rows], up[rows]
            below = np.where(lo >= 0, x - self.values[np.maximum(lo, 0), every], np.iinfo(np.int64).max)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), every] - x, np.iinfo(np.int64).max)
            lower = below <= above
            step = np.where(lower, below, above)
            at = np.where(lower, np.maximum(lo, 0), np.minimum(hi, k - 1))
            down[rows], up[rows] = lo - lower, hi + ~lower
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], self.order[at, every]] = True
            new &= ~met[rows]
            met[rows] |= new
            i, j = np.nonzero(new)
            scored += len(i)
            for a in range(0, len(i), max(1, CELLS // dims)):
                part, to = rows[i[a : a + CELLS // dims]], j[a : a + CELLS // dims]
                apart = v[part] - self.centroids[to]
                far = np.einsum("ij,ij->i", apart, apart)
                # The least by (distance, number) of each row.
                first = np.lexsort((to, far, part))
                first = first[np.r_[True, part[first][1:] != part[first][:-1]]]
                row, d, c = part[first], far[first], to[first]
                better = (d < best[row]) | (d == best[row]) & (c < label[row])
                best[row[better]], label[row[better]] = d[better], c[better]
            # All lists end at once, when every centroid has been met.
            rows = rows[((step * step).sum(1) <= best[rows]) & ~met[rows].all(1)]
        return label, best, scored


def _vectors(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches, in slices that keep a step's arrays bounded, with their vectors."""
    most = max(1, CELLS // max(dims, k))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            v = part.column(part.schema.get_field_index("v")).flatten()
            yield part, v.to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moved(spark: SparkSession, made: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of what is assigned to each."""
    held = spark.sparkContext.broadcast(centroids)  # k * dimensions numbers

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(held.value)
        k, dims = lists.centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        rows, at = [], 0

        def row(which: np.ndarray) -> pa.RecordBatch:
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1) * dims, pa.int32()), pa.array(total[which].ravel()))
            return pa.record_batch([pa.array(which.astype(np.int32)), pa.array(count[which]), values], names=["cluster", "n", "sums"])

        for _, v in _vectors(batches, dims, k):
            label = lists.nearest(v)[0]
            np.add.at(total, label, v)
            np.add.at(count, label, 1)
            at += len(v)
            if at > 1 << 31:  # below 2^30 each, so that no sum passes 64 bits
                rows.append(row(np.flatnonzero(count)))
                total[:], count[:], at = 0, 0, 0
        yield from rows
        yield row(np.flatnonzero(count))

    parts = made.select("v").mapInArrow(sums, "cluster int, n long, sums array<long>")
    dims = range(centroids.shape[1])
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in dims])
    out = centroids.copy()
    for r in added.collect():  # a row per centroid
        out[r.cluster] = [int(r[f"s{d}"]) // r.n for d in dims]
    held.unpersist()
    return out


def first_centroids(made: DataFrame, *, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hex sha256 of ``seed:vec_id``, in that order; equal
    ids by their vectors. Rows without vec_id come last, by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in made.orderBy(key.asc_nulls_last(), "v").select("v").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable
    row of ``vectors`` (vec_id, embedding; other columns are ignored): the number of its
    nearest centroid after ``rounds`` rounds, its squared distance, the distances' sum over
    that cluster and over all, and the digest of the centroid's components, joined with
    commas. Fewer usable vectors than ``k`` give fewer centroids, none gives no rows."""
    spark = vectors.sparkSession
    made = stored(quantize(vectors, dimensions=dimensions, scale=scale), "cluster-vectors")
    centroids = first_centroids(made, k=k, seed=seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        moved = _moved(spark, made, centroids)
        if (moved == centroids).all():
            break  # so are all further rounds
        centroids = moved
    held = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(held.value)
        for part, v in _vectors(batches, dimensions, len(held.value)):
            label, distance, _ = lists.nearest(v)
            yield pa.record_batch([part.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = made.schema["vec_id"].dataType.simpleString()
    assigned = stored(made.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "cluster-assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    said = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(*, k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024) -> str:
    """``cluster`` in DuckDB SQL: a pair of tables, assignment and centroids, per round."""
    sql = f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT v, sha256('{seed}:' || vec_id::VARCHAR) AS h FROM v ORDER BY h NULLS LAST, v LIMIT {k})
)"""
    assigned = """, a{t} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v CROSS JOIN c{t})
  GROUP BY ALL)"""
    moved = """, c{n} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{t} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY d) AS m FROM (
      SELECT cluster, d, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS mean
      FROM (SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{t}) GROUP BY ALL))
    GROUP BY cluster) USING (cluster))"""
    for t in range(rounds):
        sql += assigned.format(t=t) + moved.format(t=t, n=t + 1)
    return f"""{sql}{assigned.format(t=rounds)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
