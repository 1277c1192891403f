"""Line dedup by a segment-partition edit join.

Two lines within ``EDITS`` edits share, unchanged, at least one of the
``EDITS + 1`` segments into which the shorter one is cut, shifted by few places.
So each line is filed under its own segments and under the substrings that could
be a segment of a line as long or up to EDITS shorter (multi-match-aware
windows); keys are hashes of (length, segment number, substring). Lines that
share a key are compared by a banded bit-parallel edit distance.

Only keys and 8-byte line hashes are shuffled for the search. Keys with a single
line are dropped, and texts are fetched for the lines left. A key under which
over ``HOT`` lines meet is replaced by keys of two segments out of
``EDITS + 2``, of which a close pair shares two. A finer group that is still larger
is dealt out in blocks of about ``HOT`` lines, and each pair of blocks is a group. So
no task holds more than two blocks, and no pair is left out. Groups yield a spanning
forest of their links.

A line class is a connected component of equal or close lines. Its first
occurrence, by document, then line, stays. Equal lines count at any length but
none; close ones from ``EDIT_SHORT`` characters on, of which two edits are a
sixth. In shorter lines, words with nothing in common are within two edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, least_linked, map_texts, small, stored, text_slices

EDITS = 2
#: Lines under SHORT characters, the empty ones, are left alone; those under EDIT_SHORT go by equality alone.
SHORT, EDIT_SHORT = 1, 12
HOT = 512
#: Lines whose keys a task remembers to have sent.
SENT = 200_000
#: Pairs, and characters of lines, compared at once; groups of up to SMALL lines are compared pair by pair.
PAIRS, CHARS, SMALL = 16_384, 1 << 21, 32


def line_hash(line: str) -> int:
    """As Spark's xxhash64 of the line, signed."""
    h = xxhash.xxh64_intdigest(line.encode(errors="surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def second_hash(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode(errors="surrogatepass"), 43)
    return h - (1 << 64) if h >> 63 else h


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, length) of ``count`` nearly even segments, longer ones last."""
    base, long = divmod(length, count)
    size = [base + (i >= count - long) for i in range(count)]
    return [(sum(size[:i]), size[i]) for i in range(count)]


def _windows() -> list[tuple[int, int, int]]:
    """(delta, segment, shift): where segment i of a line delta shorter may stand."""
    out = []
    for delta in range(EDITS + 1):
        for i in range(EDITS + 1):
            low = max(-i, delta - (EDITS - i))
            high = min(i, delta + (EDITS - i))
            out += [(delta, i, shift) for shift in range(low, high + 1)]
    return out


def _pair_windows() -> list[tuple[int, int, int, int, int]]:
    """(delta, i, j, shift of i, shift of j) for two of EDITS + 2 segments that stand unchanged."""
    span = range(-EDITS, EDITS + 1)
    return [(d, i, j, a, b) for d in range(EDITS + 1) for i, j in combinations(range(EDITS + 2), 2) for a in span for b in span if abs(a) + abs(b - a) + abs(d - b) <= EDITS]


_WINDOWS, _PAIR_WINDOWS = _windows(), _pair_windows()


@lru_cache(maxsize=1 << 15)
def _places(n: int) -> list[tuple[int, int, int]]:
    """(begin, end, seed) in UTF-32 bytes of the substrings under which a line of n characters is filed."""
    out = []
    for delta, i, shift in _WINDOWS:
        length = n - delta
        if length >= EDIT_SHORT:
            start, size = segments(length, EDITS + 1)[i]
            if 0 <= start + shift <= n - size:
                out.append((4 * (start + shift), 4 * (start + shift + size), length * 8 + i))
    return out


def keys(line: str) -> list[int]:
    """Hashes under which a line is filed."""
    raw, digest = line.encode("utf-32-le", "surrogatepass"), xxhash.xxh64_intdigest
    return [digest(raw[a:b], seed) for a, b, seed in _places(len(line))]


def fine_keys(line: str) -> set[int]:
    """Hashes of two segments each, for lines that meet too many others under one."""
    n, raw, out = len(line), line.encode("utf-32-le", "surrogatepass"), set()
    for delta, i, j, a, b in _PAIR_WINDOWS:
        length = n - delta
        if length >= EDIT_SHORT:
            parts = segments(length, EDITS + 2)
            (p, s), (q, t) = parts[i], parts[j]
            if p + a >= 0 and q + b >= p + a + s and q + b + t <= n:
                out.add(xxhash.xxh64_intdigest(raw[4 * (p + a) : 4 * (p + a + s)] + raw[4 * (q + b) : 4 * (q + b + t)], (length * 8 + i) * 8 + j))
    return out


def _shared(flat: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many characters from a and b on (way 1) or back (way -1) are the same, up to ``most``."""
    out, live, step = np.zeros(len(a), np.int64), np.arange(len(a)), np.arange(16)
    while len(live):
        x = out[live][:, None] + step
        inside = x < most[live][:, None]
        x = np.where(inside, way * x, 0)
        same = inside & (flat[a[live][:, None] + x] == flat[b[live][:, None] + x])
        run = np.where(same.all(1), 16, same.argmin(1))
        out[live] += run
        live = live[run == 16]
    return out


def within_edits(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Whether lines i[k] and j[k] are within ``edits`` edits, for all k at once.

    Line r is flat[start[r]] and on. What both begin and end with is passed over,
    which leaves the distance as it is. After x characters of the second line, bit
    d + edits of state[e] says that x + d characters of the first match them with
    at most e edits. A step shifts and combines whole bands; a pair without any
    state left is dropped.
    """
    ok = np.zeros(len(i), bool)
    swap = size[i] > size[j]
    a, b = np.where(swap, i, j), np.where(swap, j, i)
    width = 2 * edits + 1
    full = np.uint16((1 << width) - 1)
    live = np.flatnonzero((size[a] - size[b] <= edits) & (size[b] > 0))
    ok[(size[a] <= edits) & (size[b] == 0)] = True
    a_at, b_at, a_n, b_n = start[a[live]], start[b[live]], size[a[live]], size[b[live]]
    if len(live):
        front = _shared(flat, a_at, b_at, b_n, 1)
        back = _shared(flat, a_at + a_n - 1, b_at + b_n - 1, b_n - front, -1)
        a_at, b_at, a_n, b_n = a_at + front, b_at + front, a_n - front - back, b_n - front - back
    state = [np.full(len(live), sum(1 << edits + d for d in range(e + 1)), np.uint16) for e in range(edits + 1)]
    padded = np.concatenate([np.zeros(edits, flat.dtype), flat, np.zeros(edits + 1, flat.dtype)])
    x = 0
    while len(live):
        ended = b_n == x
        if ended.any():
            ok[live[ended]] = state[edits][ended] >> (a_n - b_n + edits)[ended].astype(np.uint16) & 1 == 1
        keep = ~ended & (state[edits] != 0)
        if not keep.all():
            live, a_at, b_at, a_n, b_n = live[keep], a_at[keep], b_at[keep], a_n[keep], b_n[keep]
            state = [r[keep] for r in state]
            if not len(live):
                break
        c = flat[b_at + x]
        match = np.zeros(len(live), np.uint16)
        for d in range(-edits, edits + 1):
            same = (padded[a_at + (x + d + edits)] == c) & (x + d >= 0) & (x + d < a_n)
            match |= same.astype(np.uint16) << np.uint16(d + edits)
        new = [state[0] & match]
        for e in range(1, edits + 1):
            new.append(((state[e] & match) | state[e - 1] | (state[e - 1] >> np.uint16(1)) | (new[e - 1] << np.uint16(1))) & full)
        state = new
        x += 1
    return ok


def close_forest(groups: list[list[str]]) -> list[tuple[str, str]]:
    """(line, another of its group) for a spanning forest of the close pairs in each group."""
    out, at = [], 0
    short = [g for g in groups if len(g) <= SMALL]
    while at < len(short):
        taken, pairs, chars = [], 0, 0
        while at < len(short) and pairs < PAIRS and chars < CHARS:
            taken.append(short[at])
            pairs += len(short[at]) * (len(short[at]) - 1) // 2
            chars += sum(map(len, short[at]))
            at += 1
        lines = [x for g in taken for x in g]
        first = np.cumsum([0] + [len(g) for g in taken])
        i, j = (np.concatenate(z) for z in zip(*(tuple(f + t for t in np.triu_indices(len(g), 1)) for f, g in zip(first, taken))))
        near = within_edits(*_flat(lines), i, j)
        label = least_linked(len(lines), i[near], j[near])
        out += [(lines[k], lines[label[k]]) for k in np.flatnonzero(label != np.arange(len(lines)))]
    for g in groups:
        if len(g) > SMALL:
            out += _large(g)
    return out


def _flat(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def _large(lines: list[str]) -> list[tuple[str, str]]:
    """By breadth-first search: a line reached is compared with the unreached alone."""
    # Sorted by length: only lines of a length within EDITS matter, a run of them.
    lines = sorted(lines, key=len)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    left, out = np.arange(len(lines)), []
    while len(left):
        seed, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            low, high = np.searchsorted(size[left], [size[x] - EDITS, size[x] + EDITS + 1])
            some = left[low:high]
            per = max(1, min(PAIRS, CHARS // int(size[x] + 1)))
            near = np.zeros(len(some), bool)
            for at in range(0, len(some), per):
                part = [lines[x], *(lines[k] for k in some[at : at + per])]
                near[at : at + per] = within_edits(*_flat(part), np.zeros(len(part) - 1, np.int64), np.arange(1, len(part)))
            front += some[near].tolist()
            out += [(lines[k], lines[seed]) for k in some[near]]
            left = np.concatenate([left[:low], some[~near], left[high:]])
    return out


# Spark side


def _filed(docs: DataFrame) -> DataFrame:
    """(key, h1): each line of EDIT_SHORT characters or more under all of its keys."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for part in text_slices(batches):
            key, h = [], []
            for text in part.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) >= EDIT_SHORT and (mark := xxhash.xxh3_128_digest(line.encode(errors="surrogatepass"))) not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(mark)
                        own = keys(line)
                        key += own
                        h += [line_hash(line)] * len(own)
            yield _long_batch({"key": np.array(key, np.uint64).view(np.int64), "h1": np.array(h, np.int64)})

    return map_texts(docs.select("text"), file, "key long, h1 long")


def _long_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns.values()], names=list(columns))


def _met(filed: DataFrame, hot: int) -> DataFrame:
    """(key, h1, hot): the rows of ``filed``, once each, whose key has several lines;
    hot, if these are over ``hot``. At most that many rows of a key are held at once."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key: np.ndarray, h: np.ndarray, over: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(key), pa.array(h), pa.array(over)], names=["key", "h1", "hot"])

        def done(key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(key)])
            size = np.repeat(size, size)
            return rows(key[size > 1], h[size > 1], size[size > 1] > hot)

        none = np.empty(0, np.int64)
        rest, before, open_key = (none, none), None, None
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.r_[before != (key[0], h[0]), (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
            before = (key[-1], h[-1])
            key, h = np.concatenate([rest[0], key[new]]), np.concatenate([rest[1], h[new]])
            if open_key is not None:
                # A key known to be hot: its rows go on as they come.
                own = int(np.searchsorted(key, open_key, side="right"))
                yield rows(key[:own], h[:own], np.ones(own, bool))
                key, h = key[own:], h[own:]
            if len(key):
                open_key, whole = None, int(np.searchsorted(key, key[-1]))
                if whole:
                    yield done(key[:whole], h[:whole])
                key, h = key[whole:], h[whole:]
                if len(key) > hot:
                    yield done(key, h)
                    open_key, key, h = key[-1], none, none
            rest = (key, h)
        yield done(*rest)

    return filed.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(meet, "key long, h1 long, hot boolean")


def _dealt(finer: DataFrame) -> DataFrame:
    """(key, h1) from stored ``finer`` (key, h1, hot): the rows of a hot key under the
    keys of all pairs of blocks that their own is in."""
    blocks = stored(finer.filter("hot").groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")), "lines-blocks")
    own = F.pmod("h1", "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("key", F.least(own, k), F.greatest(own, k)))
    hot = finer.filter("hot").join(small(blocks, blocks.count()), "key").select(F.explode(pairs).alias("key"), "h1")
    return finer.filter("not hot").select("key", "h1").unionByName(hot)


def links(docs: DataFrame) -> DataFrame:
    """(a, b) node names (see ``node``) of a forest whose components are those of
    all close pairs of distinct lines."""
    met = stored(_met(_filed(docs), HOT), "lines-met")
    wanted = stored(met.select("h1").distinct(), "lines-wanted")
    line = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.length("line") >= EDIT_SHORT).withColumn("h1", F.xxhash64("line"))
    texts = stored(line.join(small(wanted, wanted.count()), "h1", "left_semi").groupBy("line").agg(F.first("h1").alias("h1")), "lines-texts")

    def refile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, h) for line, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in fine_keys(line)]
            yield _long_batch({"key": np.array([k for k, _ in rows], np.uint64).view(np.int64), "h1": np.array([h for _, h in rows], np.int64)})

    crowded = texts.join(met.filter("hot").select("h1").distinct(), "h1", "left_semi").select("line", "h1")
    finer = stored(_met(map_texts(crowded, refile, "key long, h1 long"), HOT), "lines-finer")
    grouped = met.filter("not hot").select("key", "h1").unionByName(_dealt(finer)).join(texts, "h1").select("key", "line")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, ready, waiting = None, [], [], 0

        def done(groups: list[list[str]]) -> pa.RecordBatch:
            found = close_forest(groups)
            cols = [[f(x[s]) for x in found] for s in (0, 1) for f in (line_hash, second_hash)]
            return _long_batch(dict(zip(("a1", "a2", "b1", "b2"), (np.array(c, np.int64) for c in cols))))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if len(group) > 1:
                        ready.append(group)
                        waiting += len(group) ** 2 + sum(map(len, group)) // 64
                    now, group = key, []
                    if waiting > 4 * PAIRS:
                        yield done(ready)
                        ready, waiting = [], 0
                group.append(text)
        yield done([*ready, group] if len(group) > 1 else ready)

    made = map_texts(grouped.repartition("key").sortWithinPartitions("key"), compare, "a1 long, a2 long, b1 long, b2 long")
    return made.select(node("a1", "a2").alias("a"), node("b1", "b2").alias("b"))


def node(h1: str, h2: str):
    return F.concat_ws(":", F.hex(h1), F.hex(h2))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, line_no, h1, h2) of the lines of SHORT characters or more."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            row, no, h = [], [], []
            for r, text in enumerate(part.column(2).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    if len(line) >= SHORT:
                        row.append(r)
                        no.append(k)
                        h.append((line_hash(line), second_hash(line)))
            at, pair = pa.array(row, pa.int64()), np.array(h, np.int64).reshape(-1, 2)
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(no, pa.int32()), pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["doc_id", "doc_hash", "line_no", "h1", "h2"])

    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text"), make, "doc_id long, doc_hash long, line_no int, h1 long, h2 long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, lines): the numbers of the lines to remove, per document."""
    found = stored(occurrences(docs), "lines-occurrences")
    place = F.struct("doc_id", "doc_hash", "line_no")
    every = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    root = connected_components(links(docs))
    member = stored(root.select("node", "root").unionByName(root.select(F.col("root").alias("node"), "root")).distinct(), "lines-classes")
    classed = every.withColumn("node", node("h1", "h2")).join(member, "node", "left").filter("n > 1 or root is not null")
    classed = stored(classed.select("h1", "h2", "first", F.coalesce("root", "node").alias("root")), "lines-repeated")
    first = classed.groupBy("root").agg(F.min("first").alias("stays"))
    stays = classed.join(first, "root").select("h1", "h2", "stays")
    gone = found.join(stays, ["h1", "h2"]).filter(place != F.col("stays"))
    return gone.groupBy("doc_id", "doc_hash").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``text`` without the
    repeated lines, and n_lines and n_removed. Null text stays null (no lines);
    rows with equal doc_id and text count as one document and are treated alike;
    null doc_ids come before others. Columns n_lines and n_removed are replaced."""
    docs = docs.drop("n_lines", "n_removed")
    gone = stored(repeats(docs), "lines-gone")
    entries = gone.agg(F.count("*") + F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    names = docs.columns
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    side = small(gone.select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__h"), F.col("lines").alias("__gone")), entries)
    both = keyed.join(side, keyed.doc_id.eqNullSafe(side["__id"]) & (keyed["__hash"] == side["__h"]), "left").select(*names, "__gone")
    at = names.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            out, total, removed = [], [], []
            for text, drop in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                lines = [] if text is None else text.split("\n")
                total.append(len(lines))
                removed.append(len(drop or ()))
                if drop:
                    away = set(drop)
                    text = "\n".join(x for k, x in enumerate(lines) if k not in away)
                out.append(text)
            cols = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(part.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return map_texts(both, strip, docs.schema.add("n_lines", "long").add("n_removed", "long"))
