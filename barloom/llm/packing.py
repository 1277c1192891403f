"""Best-fit-decreasing packing of tokenized documents into fixed-size sequences.

Documents become pieces of at most ``capacity`` ids. Best-fit decreasing takes
the pieces from long to short and puts each into the open sequence with the
least sufficient room. Pieces of one length are alike, and so are sequences of
one remaining capacity, so the plan is made on the histogram of lengths, which
has ``capacity`` entries whatever the corpus: a segment tree over remaining
capacities finds the tightest open class in logarithmic time, and a run of
equal pieces fills a run of equal sequences. The steps are exactly those of
one-by-one best-fit decreasing.

Every piece then takes its place by its rank among the pieces of its length.
Ranks come from counts by (length, salt), so no task ever holds all the pieces
of one length.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_texts, stored, text_slices

#: Words whose ids a worker remembers; beyond that it keeps those of the batch at hand.
REMEMBERED = 300_000
#: Text bytes encoded at once.
BYTES = 2 << 20
#: Pieces of one length in one salt, as a mean.
PER_SALT = 100_000
#: Salts at least.
SALTS = 256
#: Stands between words that are encoded together; a pre-token and an id of its own.
_MARK = "\x00"
#: Capitals without the composed forms that their small letters have, before a mark.
_COMPOSES = r"[HJTWY]\p{M}"


class WordEncoder:
    """Ids of texts, one encoding per distinct word.

    White space parts the pre-tokens of the vocabulary and is dropped, upper
    case is folded, and runs of letters part from other characters, so a text's
    ids are those of its space- or newline-parted words, lower-cased in ASCII.
    A tail of full stops and commas is encoded apart if an ASCII letter or digit
    stands before it: other marks make one pre-token with the tail, and other
    letters may end in a mark when they are normalized. Texts that hold a special
    token's string, or a capital whose mark composes with the small letter
    alone, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _only(self, words: set[str]) -> None:
        """Forgets all other words."""
        kept = [w for w in words if w in self.index]
        entry = np.fromiter(map(self.index.__getitem__, kept), np.int64, len(kept))
        size = self.start[entry + 1] - self.start[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        self.flat = self.flat[np.repeat(self.start[entry] - total[:-1], size) + np.arange(total[-1])]
        self.index, self.start = {w: k for k, w in enumerate(kept)}, total

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words to the memory, encoding many at once."""
        plain, odd = [], []
        for w in words:
            (odd if _MARK in w or self.mark is None else plain).append(w)
        parts, sizes = [], []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode(f" {_MARK} ".join(some), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(some) - 1:
                parts.append(np.delete(ids, cut))
                sizes.append(np.diff(np.r_[-1, cut, len(ids)]) - 1)
            else:
                own = [self.whole(w) for w in some]
                parts += own
                sizes.append(np.array([len(x) for x in own], np.int64))
        for w in odd:
            parts.append(self.whole(w))
            sizes.append(np.array([len(parts[-1])], np.int64))
        at = len(self.start) - 1
        self.index.update(zip(plain + odd, range(at, at + len(words))))
        self.flat = np.concatenate([self.flat, *parts])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null: none."""
        texts = pc.fill_null(texts, "")
        odd = [i for s in self.special for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False))]
        odd += np.flatnonzero(pc.match_substring_regex(texts, _COMPOSES).to_numpy(zero_copy_only=False)).tolist()
        words = pc.split_pattern(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        tailed = pc.match_substring_regex(coded.dictionary, "[a-z0-9][.,]+$")
        bases = pc.if_else(tailed, pc.ascii_rtrim(coded.dictionary, ".,"), coded.dictionary)
        base, kept = bases.to_pylist(), np.flatnonzero(tailed.to_numpy(zero_copy_only=False))
        tail = [w[len(base[k]) :] for w, k in zip(coded.dictionary.filter(tailed).to_pylist(), kept.tolist())]
        if len(self.index) > REMEMBERED:
            self._only({*base, *tail})
        known = self.index
        if new := list({w for w in itertools.chain(base, tail, [""]) if w not in known}):
            self._learn(new)
        b = np.fromiter(map(known.__getitem__, base), np.int64, len(base))
        t = np.full(len(b), known[""])
        t[kept] = np.fromiter(map(known.__getitem__, tail), np.int64, len(tail))
        entry = np.empty(2 * len(b), np.int64)
        entry[0::2], entry[1::2] = b, t
        size = (self.start[1:] - self.start[:-1])[entry]
        at = np.concatenate([[0], np.cumsum(size)])
        own = self.flat[np.repeat(self.start[entry] - at[:-1], size) + np.arange(at[-1])]  # ids of each distinct word of this batch
        code = coded.indices.to_numpy()
        word_size, word_at = (size[0::2] + size[1::2])[code], at[:-1:2][code]
        total = np.concatenate([[0], np.cumsum(word_size)])
        ids = own[np.repeat(word_at - total[:-1], word_size) + np.arange(total[-1])]
        bound = total[np.concatenate([[0], np.cumsum(per_text)])]
        if odd:
            parts = [ids[bound[i] : bound[i + 1]] for i in range(len(texts))]
            for i in set(odd):
                parts[i] = self.whole(texts[i].as_py())
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.diff(bound)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, *, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``,
    cut only if longer than ``capacity``. Null text: empty, so ``end_id`` alone.
    Repeated rows are documents of their own."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in text_slices(batches, limit=BYTES):
            ids, size = enc.encode(part.column(1))
            ids = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
            size = size + 1
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            at = np.repeat(np.cumsum(size) - size, count) + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Tree:
    """Segment tree over remaining capacities: which of them have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def put(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing on {length: count}. A row (length, first, last, bin,
    each, room), in order of length and first, says: the pieces of that length with ranks first to last - 1 go,
    ``each`` at a time, to the sequences from ``bin`` on, which have ``room`` left."""
    tree, open_bins, rows, bins = _Tree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, many = bins, -(-(count - rank) // each)
                bins += many
                room = capacity
            else:
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
                each = room // length
            full = min(many, (count - rank) // each)
            placed = full * each
            left = 0
            if full < many and rank + placed < count:
                left = count - rank - placed
            rows.append((length, rank, rank + placed + left, first, each, room))
            for at, n, now in ((first, full, room - each * length), (first + full, int(left > 0), room - left * length), (first + full + (left > 0), many - full - (left > 0), room)):
                if n and now:
                    if not open_bins.setdefault(now, []):
                        tree.put(now, True)
                    open_bins[now].append((at, n))
            rank += placed + left
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def place(found: DataFrame, *, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored ``found`` (..., length)."""
    spark = found.sparkSession
    counted = found.groupBy("length", "salt").count()
    # At most a row per length goes to the driver, so its size has a fixed bound.
    histogram = {r.length: r["count"] for r in counted.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    bound = 1 << 48
    step = spark.sparkContext.broadcast(plan(histogram, capacity))

    before = counted.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = found.withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    kept = [c for c in found.columns if c not in ("uid", "salt")]

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = step.value[:, 0] * bound + step.value[:, 1]
        for batch in batches:
            length, rank = (batch.column(len(kept) + k).to_numpy() for k in range(2))
            x = step.value[np.searchsorted(key, length * bound + rank, side="right") - 1]
            t = rank - x[:, 1]
            cols = [*batch.columns[: len(kept)], pa.array(x[:, 3] + t // x[:, 4]), pa.array(capacity - x[:, 5] + t % x[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sequence_id", "offset"])

    ordered = ranked.select(*kept, F.col("length").alias("__length"), "rank")
    return ordered.mapInArrow(spot, found.select(*kept).schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, *, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all of
    ``docs`` (doc_id, text; other columns are ignored). Null and empty texts are
    the end id alone; an empty table gives no rows; null doc_ids pass through."""
    made = stored(pieces(docs, vocabulary=vocabulary, capacity=capacity, end_id=end_id).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    salts = max(SALTS, -(-made.count() // PER_SALT))
    return place(made.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts))), capacity=capacity)
