"""What several operators share: stored intermediate tables, bounded slices of
Arrow batches, and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.stored import removed, shared_dir, written

#: Text bytes that one step inside a task works on; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: The setting that bounds an Arrow batch by bytes.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of ids, hashes and the like up to which a table is broadcast (under 100 MB).
SMALL_ROWS = 1_000_000


#: Tables stored since the innermost open ``workspace`` of this thread began.
_OPEN: ContextVar[list[str] | None] = ContextVar("open workspace", default=None)


def stored(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its work is
    done once, lost executors cost no recomputation, and its size is known. Unless
    ``lasting``, the table goes with the ``workspace`` it was made in; else with the session."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    made = _OPEN.get()
    if made is not None and not lasting:
        made.append(path)
    return written(df, path)


@contextmanager
def workspace(spark: SparkSession):
    """Deletes on exit the tables stored within, by this thread: for work whose result was written by then."""
    made: list[str] = []
    before = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for path in made:
            removed(spark, path)


def small(df: DataFrame, n: int, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` of ``n`` rows as the side of a join: broadcast up to ``most``, else left to a shuffle."""
    return F.broadcast(df) if n <= most else df


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Returns freed memory of a worker process, which outlives its task, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` for rows with texts: executor and worker hold batches of about
    ``SLICE_BYTES`` instead of 64 MB, however long the texts. Lowers the session's
    setting, unless it is lower already; no row goes, as it only bounds a batch."""
    conf, as_bytes = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(conf.get(_BATCH_BYTES)) > SLICE_BYTES:
        conf.set(_BATCH_BYTES, f"{SLICE_BYTES}b")
    return df.mapInArrow(make, schema)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that is linked to each of n rows, by the links i - j."""
    label = np.arange(n)
    while True:
        new, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def hashes(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b) but the roots;
    a root is the least node of its component.

    Alternates large-star and small-star steps, which keep the number of edges
    at most the input's and need about log(diameter) rounds. Group minima are
    partially aggregated, so a hub meets no single task; the joins on the hub
    are plain equi-joins that adaptive execution may split. Each round is cut
    by a reliable checkpoint.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = cut(edges.filter("a != b").select(*pair(F.col("a"), F.col("b"))).distinct())
    before = hashes(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(*pair(F.col("b"), F.col("m"))).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(*pair(F.col("b"), F.col("m")))
        now = cut(small.unionByName(least.select(F.col("a"), F.col("m").alias("b"))).distinct())
        after = hashes(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
