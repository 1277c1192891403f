"""Packing into windows by non-negative least squares.

Documents longer than a window give whole windows and a rest; what is left is a
histogram of lengths. Shallow combinations of lengths, two or three that fill a window
exactly, are enumerated, and their repeat counts solve ``min |A x - h|^2, x >= 0``,
``A`` saying how often a combination takes a length and ``h`` being the histogram. The
counts are rounded, as far as there are pieces; what that leaves is packed greedily,
longest first, each piece into the open window, cut where it is full. The last window's
rest is cut into powers of two, which need no padding; so nothing is padded.

The plan is made on the driver and depends on the window's length alone, whatever the
corpus. Every piece then takes its place by its rank among the pieces of its length,
from counts by (length, salt), so no task ever holds all the pieces of one length. Ids
are stored beside the pieces and read again for those that were cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, map_texts, small, stored, text_slices
from .bytebpe import bounds, encoder

#: Pieces of one length in one salt, as a mean, and salts at least.
PER_SALT, SALTS = 100_000, 256
#: Steps of the solver, and lengths that a combination of three may take as its shortest.
STEPS, SHORTEST = 6000, 512


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of lengths that occur, a >= b >= c, with sum ``window``; c is 0 for
    two. Of three, the shortest is one of the SHORTEST most frequent lengths, which bounds
    their number by SHORTEST * window / 2."""
    has = histogram > 0
    a = np.arange(-(-window // 2), window)
    b = window - a
    rows = [np.stack([a, b, np.zeros_like(a)], 1)[has[a] & has[b]]]
    shortest = np.flatnonzero(has[: window // 3 + 1])
    shortest = np.sort(shortest[np.argsort(-histogram[shortest], kind="stable")][:SHORTEST])
    for c in shortest.tolist():
        b = np.arange(c, (window - c) // 2 + 1)
        a = window - c - b
        rows.append(np.stack([a, b, np.full_like(a, c)], 1)[has[a] & has[b]])
    return np.concatenate(rows)


def repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares by coordinate descent, the steepest coordinate first;
    each step sets one combination's count to its best value given the others. Ends when
    no step would change a count by half a repeat."""
    left = histogram.astype(np.float64)
    left[0] = 0
    x = np.zeros(len(combos))
    a, b, c = combos.T
    # Square sums of how often a combination takes each of its lengths.
    norm = np.select([(a == b) & (b == c), (a == b) | (b == c), c > 0], [9.0, 5.0, 3.0], 2.0)
    norm[(a == b) & (c == 0)] = 4.0
    root = np.sqrt(norm)
    for _ in range(steps if len(combos) else 0):
        step = np.maximum((left[a] + left[b] + left[c]) / norm, -x)
        at = int((root * np.abs(step)).argmax())
        if abs(step[at]) < 0.5:
            break
        x[at] += step[at]
        np.subtract.at(left, combos[at], step[at])
        left[0] = 0
    return x


def plan(histogram: dict[int, int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rest) for {length: count}, lengths up to ``window``. A row (length, rank,
    base, each, offset), by length and rank, holds from that rank on: with ``each`` > 0
    pieces go ``each`` at a time, at ``offset`` and after, to the sequences from ``base``
    on; with 0 they follow one another in the stream that begins at token ``base``. The
    stream's sequences are its windows, then its ``rest``, of which the begins and the
    end are given; other sequences are numbered after them."""
    h = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        h[length] = count
    h[window], whole = 0, int(h[window])
    combos = combinations(h, window)
    x = repeats(combos, h)
    used, chosen = np.zeros_like(h), []
    for at in np.argsort(-x, kind="stable")[: np.count_nonzero(x >= 0.5)].tolist():
        kinds, many = np.unique([p for p in combos[at].tolist() if p], return_counts=True)
        n = min(int(np.rint(x[at])), int(((h[kinds] - used[kinds]) // many).min()))
        if n > 0:
            chosen.append((n, kinds[::-1].tolist(), many[::-1].tolist()))
            used[kinds] += n * many
    left = h - used
    full, tail = divmod(int((left * np.arange(window + 1)).sum()), window)
    rest = [full * window]
    for bit in range(tail.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            rest.append(rest[-1] + (1 << bit))
    sequence, rows, rank = full + len(rest) - 1, [], np.zeros_like(h)
    if whole:
        rows.append((window, 0, sequence, 1, 0))
        sequence += whole
    for n, kinds, many in chosen:
        offset = 0
        for length, times in zip(kinds, many):
            rows.append((length, int(rank[length]), sequence, times, offset))
            rank[length] += n * times
            offset += times * length
        sequence += n
    at = 0
    for length in range(window - 1, 0, -1):
        if left[length]:
            rows.append((length, int(rank[length]), at, 0, 0))
            at += int(left[length]) * length
    return np.array(sorted(rows), np.int64).reshape(-1, 5), np.array(rest, np.int64)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, *, vocabulary: str, window: int, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): each text's ids and ``end_id`` in
    whole windows and a rest; ``ids`` are unsigned little-endian numbers of 32 bits, or of
    16 if the vocabulary has no larger. Null text: empty, so ``end_id`` alone. Repeated
    rows are documents of their own."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in text_slices(batches, limit=SLICE_BYTES):
            ids, size = enc.encode(part.column(1))
            ids = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
            size = size + 1
            count = -(-size // window)
            row = np.repeat(np.arange(len(size)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, size[row] - start)
            raw, at = memoryview(ids).cast("B"), bounds(length)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            kept = ids.astype(enc.width)
            held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((at * kept.itemsize).astype(np.int32)), pa.py_buffer(kept)])
            yield pa.record_batch([part.column(0).take(pa.array(row)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(size[row]), held], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return map_texts(docs.select("doc_id", "text"), make, f"{_PIECE}, ids binary")


def place(found: DataFrame, *, window: int, width: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of stored ``found``,
    which has ``ids`` of ``width``, and uid and salt."""
    spark = found.sparkSession
    counted = found.groupBy("length", "salt").count()
    # At most a row per length goes to the driver, so its size has a fixed bound.
    histogram = {r.length: r["count"] for r in counted.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    # Some hundred rows per length at most, whatever the corpus.
    made = spark.sparkContext.broadcast(plan(histogram, window))
    before = counted.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = found.drop("ids").withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, rest = made.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            _, first, base, each, offset = rows[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1].T
            t, n = rank - first, np.maximum(each, 1)
            at = base + t * length
            sequence, begin, _ = _sequence(at, rest, window)
            flows = each == 0
            cut = flows & (_sequence(at + length - 1, rest, window)[0] != sequence)
            yield pa.record_batch([*batch.columns[:6], *map(pa.array, (np.where(flows, sequence, base + t // n), np.where(flows, at - begin, offset + t % n * length), at, cut))], names=[*names, "uid", "sequence_id", "offset", "at", "cut"])

    placed = stored(ranked.select(*names, "uid", "rank").mapInArrow(spot, f"{_PIECE}, uid long, sequence_id long, offset long, at long, cut boolean"), "window-places")
    whole, cut = placed.filter("not cut").select(*names, "sequence_id", "offset"), placed.filter("cut")
    held = small(cut, cut.count()).join(found.select("uid", "ids"), "uid").select(*names, "at", "ids")

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rest = made.value
        for batch in batches:
            out = []
            for doc_id, start, length, _, tokens, at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                ids, done = np.frombuffer(ids, width).astype("<u4"), 0
                while done < length:
                    sequence, begin, end = (int(x[0]) for x in _sequence(np.array([at + done]), rest, window))
                    n = min(length - done, end - at - done)
                    out.append((doc_id, start + done, n, zlib.crc32(ids[done : done + n].tobytes()), tokens, sequence, at + done - begin))
                    done += n
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=[*names, "sequence_id", "offset"])

    return whole.unionByName(held.mapInArrow(divide, f"{_PIECE}, sequence_id long, offset long"))


def _sequence(at: np.ndarray, rest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, begin and end of the stream's sequences that hold these tokens of it."""
    k = np.clip(np.searchsorted(rest, at, side="right") - 1, 0, max(0, len(rest) - 2))
    in_rest = at >= rest[0]
    begin = np.where(in_rest, rest[k], at // window * window)
    end = np.where(in_rest, rest[np.minimum(k + 1, len(rest) - 1)], begin + window)
    return np.where(in_rest, rest[0] // window + k, at // window), begin, end


def pack(docs: DataFrame, *, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for all of ``docs``
    (doc_id, text; other columns are ignored). Every sequence is full or as long as a power
    of two. Null and empty texts are the end id alone; an empty table gives no rows; null
    doc_ids pass through. ``window`` is a power of two, or else its own rest may be padded."""
    made = stored(pieces(docs, vocabulary=vocabulary, window=window, end_id=end_id).withColumn("uid", F.monotonically_increasing_id()), "window-pieces")
    salts = max(SALTS, -(-made.count() // PER_SALT))
    return place(made.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts))), window=window, width=encoder(vocabulary).width)
