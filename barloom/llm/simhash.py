"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints lie in vertical bit planes: plane b holds bit b of 64 rows per
machine word, so one carry-save step updates 64 distances at once, and a block
is left as soon as all of its distances exceed the radius.

Two ways find the buckets of rows that are compared:

* exact (64 planes, radius r): the bits are cut into r + 4 blocks; two
  fingerprints within r bits agree on at least 4 blocks, so equality on each
  choice of 4 blocks finds every link.
* sampled (more planes): equality on seeded choices of bits. Their width grows
  with the number of fingerprints, so that a bucket holds ``MEAN_BUCKET`` rows
  on average at any size, and their number with the width, so that a pair at the
  threshold meets with the same probability.

Equal fingerprints are one row before any comparison. A bucket yields a spanning
forest of its links, near ones first, never all of its pairs; one of over ``HOT``
rows is dealt out as pairs of bounded blocks.

``deduplicate`` takes the links of the sampled way as candidates only: each is
held against the shingle sets of its two texts, and counts from a Jaccard
similarity of ``similarity`` on. Sets travel only for candidates whose sketches of
512 bytes leave the similarity possible, so a corpus of pages from one template,
somewhat alike, doesn't send each text along with each of its candidates.

That joins most of what belongs together, but not all: a pair at the similarity may
meet in no bucket, differ on more planes than the radius, fail a sketch, or be left
out by a forest for nearer links that fail. ``remaining`` finds all links that are
missing, without a cut: sets that share enough share one of their rarest shingles
(prefix filter: Chaudhuri, Ganti, Kaushik 2006; Xiao et al. 2008), so texts that are
still apart meet under each of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import connected_components, give_back, map_texts, small, stored, text_slices, utf8

SEED = 42
#: From this size on, a bucket is compared by breadth-first search over its own planes.
WIDE = 64
#: Rows over which a bucket is dealt out in blocks of that size. One fingerprint in
#: SAMPLED counts buckets beforehand, which decides how work is dealt, not what is found.
HOT, SAMPLED = 65_536, 64
#: Sampled buckets: rows on average, least width in bits, and the expected number of
#: common buckets of a pair at the threshold, of which e^-6.8, a thousandth, has none.
MEAN_BUCKET, LEAST_WIDTH, MEETINGS = 16, 16, 6.8
#: Rows whose planes are compared at once.
FRONT = 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(raw: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles, repeats included; words are ASCII-lower-cased
    runs of bytes other than ASCII white space. Fewer words: one hash of them all."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return np.array([digest(whole, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: n - k + 1].tolist(), end[k - 1 :].tolist()
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(start, end)), np.uint64, n - k + 1)


def majority(h: np.ndarray, planes: int) -> np.ndarray:
    """The fingerprint words: bit b is 1 if set in over half of the hashes. Words
    after the first come from a bijective mix of the hashes."""
    out = np.zeros(planes // 64, np.uint64)
    if not len(h):
        return out
    for w in range(planes // 64):
        x = h
        if w:
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            bits = np.unpackbits(np.ascontiguousarray(x[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
            ones += bits[whole:].sum(0, dtype=np.int64)
        out[w] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, *, shingle_words: int, planes: int = 64, id_type: str = "long", distinct: bool = False) -> DataFrame:
    """(doc_id, f0, f1, ...) per row of ``docs``; null or wordless text: zeros.
    ``distinct``: a repeated shingle counts once, and ``s`` is a hash of the set."""
    words = planes // 64
    names = [f"f{i}" for i in range(words)] + ["s"] * distinct

    def one(raw: bytes) -> np.ndarray:
        h = shingle_hashes(raw, shingle_words)
        if not distinct:
            return majority(h, planes)
        h = np.unique(h)
        return np.append(majority(h, planes), np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = np.array([one(t) for t in utf8(part.column(1))], np.uint64).reshape(-1, len(names))
            yield pa.record_batch([part.column(0), *(pa.array(found[:, i].view(np.int64)) for i in range(len(names)))], names=["doc_id", *names])

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names))


# Bit-sliced comparison


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """[rows, words] to [planes, ceil(rows / 64)]."""
    n, words = prints.shape
    bits = np.zeros((-(-n // 64) * 64, 64 * words), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (carry, sum) of three bit vectors."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _above(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Where the vertical counter (low bit first) is over ``limit``."""
    over, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for i in reversed(range(len(counter))):
        if limit >> i & 1:
            equal = equal & counter[i]
        else:
            over |= equal & counter[i]
            equal = equal & ~counter[i]
    return over


def within(differences: Iterator[np.ndarray], radius: int, out: np.ndarray) -> np.ndarray:
    """Bit vector of the rows with at most ``radius`` set differences. ``out``:
    rows known to be out. Eight planes at a time pass through carry-save adders."""
    zero = np.zeros_like(out)
    counter = [zero] * max(4, (radius + 9).bit_length() + 1)
    group: list[np.ndarray] = []
    for x in differences:
        group.append(x)
        if len(group) < 8:
            continue
        one, two, four = counter[:3]
        a, one = _add(one, group[0], group[1])
        b, one = _add(one, group[2], group[3])
        c, two = _add(two, a, b)
        a, one = _add(one, group[4], group[5])
        b, one = _add(one, group[6], group[7])
        d, two = _add(two, a, b)
        carry, four = _add(four, c, d)
        counter[:3] = one, two, four
        for i in range(3, len(counter)):
            carry, counter[i] = counter[i] & carry, counter[i] ^ carry
        group = []
        out = out | _above(counter, radius) | carry
        if (out == _ALL).all():
            break
    return ~out


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def _wide(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that span one large bucket: breadth-first searches
    within a third, two thirds and all of the radius, each over what the one before
    has joined, so that near links come first."""
    n = len(prints)
    planes = bit_planes(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
    label, child, parent = np.arange(n), [], []
    for reach in sorted({radius // 3, 2 * radius // 3, radius}):
        by_label = np.argsort(label, kind="stable")
        first = np.searchsorted(label[by_label], np.arange(n))
        last = np.searchsorted(label[by_label], np.arange(n), side="right")
        left = np.full(planes.shape[1], _ALL)
        if n % 64:
            left[-1] = np.uint64((1 << n % 64) - 1)

        def take(labels: np.ndarray) -> np.ndarray:
            """The rows of some labels, which are no longer left."""
            rows = np.concatenate([by_label[first[k] : last[k]] for k in labels])
            gone = np.zeros(planes.shape[1] * 64, np.uint8)
            gone[rows] = 1
            left[:] &= ~np.packbits(gone, bitorder="little").view(np.uint64)
            return rows

        joined = label.copy()
        for seed in np.unique(label):
            if not left[by_label[first[seed]] // 64] >> np.uint64(by_label[first[seed]] % 64) & np.uint64(1):
                continue
            front = take(np.array([seed]))
            while len(front) and left.any():
                now, front = front[:FRONT], front[FRONT:]
                mask = np.where(bits[now], _ALL, np.uint64(0))
                out = np.broadcast_to(~left, (len(now), len(left)))
                near = within((planes[b][None, :] ^ mask[:, b, None] for b in range(len(planes))), reach, out) & left
                new = np.flatnonzero(_unpack(np.bitwise_or.reduce(near, axis=0), n))
                if len(new):
                    labels, at = np.unique(label[new], return_index=True)
                    new = new[at]
                    child.append(new)
                    parent.append(now[(near[:, new // 64] >> (new % 64).astype(np.uint64) & np.uint64(1)).argmax(0)])
                    rows = take(labels)
                    joined[rows] = seed
                    front = np.concatenate([front, rows])
        label = joined
    empty = [np.empty(0, np.int64)]
    return np.concatenate(child or empty), np.concatenate(parent or empty)


def _narrow(prints: np.ndarray, bucket: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that span many small buckets side by side, the nearest
    that do: row j is compared with row j + d."""
    n = len(prints)
    planes = bit_planes(prints)
    pad = np.zeros((len(planes), 1), np.uint64)
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, int(size.max(initial=1))):
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: n - d] = bucket[d:] == bucket[:-d]
        out = ~np.packbits(same, bitorder="little").view(np.uint64)
        near = within((planes[b] ^ ((planes[b] >> np.uint64(d)) | (np.append(planes[b][1:], pad[b]) << np.uint64(64 - d))) for b in range(len(planes))), radius, out)
        at = np.flatnonzero(_unpack(near, n))
        i.append(at)
        j.append(at + d)
    return _nearest_forest(n, np.concatenate(i), np.concatenate(j), prints)


def distances(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64)


def _nearest_forest(n: int, i: np.ndarray, j: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of least distance that connect what all links i - j do: each
    component takes its nearest, until none leads out of one."""
    order = np.lexsort((j, i, distances(prints, i, j)))
    i, j, label, taken = i[order], j[order], np.arange(n), np.zeros(len(i), bool)
    while True:
        a, b = label[i], label[j]
        out = np.flatnonzero(a != b)
        if not len(out):
            return j[taken], i[taken]
        least = np.full(n, len(i))
        np.minimum.at(least, a[out], out)
        np.minimum.at(least, b[out], out)
        chosen = np.unique(least[least < len(i)])
        taken[chosen] = True
        # Labels of a component go down to its least one.
        while True:
            low = np.minimum(label[i[chosen]], label[j[chosen]])
            new = label.copy()
            np.minimum.at(new, label[i[chosen]], low)
            np.minimum.at(new, label[j[chosen]], low)
            new = new[label]
            if (new == label).all():
                break
            label = new


def forest(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (child, parent) of links that span those inside buckets; rows come sorted by bucket."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(bucket)])
    child, parent = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, m in zip(start[size >= WIDE], size[size >= WIDE]):
        a, b = _wide(prints[s : s + m], radius)
        child.append(a + s)
        parent.append(b + s)
    per_row = np.repeat(size, size)
    rows = np.flatnonzero((per_row > 1) & (per_row < WIDE))
    for at in _runs(rows, bucket, 1 << 16):
        a, b = _narrow(prints[at], bucket[at], per_row[at], radius)
        child.append(at[a])
        parent.append(at[b])
    return np.concatenate(child), np.concatenate(parent)


def _runs(rows: np.ndarray, bucket: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """The rows in pieces of about ``limit`` that split no bucket."""
    at = 0
    while at < len(rows):
        end = min(at + limit, len(rows))
        while end < len(rows) and bucket[rows[end]] == bucket[rows[end - 1]]:
            end += 1
        yield rows[at:end]
        at = end


# Spark side


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the choices of blocks on which a pair within the radius agrees."""
    blocks = blocks or radius + 4
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(part[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def share_of_bits(similarity: float) -> float:
    """Share of the planes on which two sets of equal size and that Jaccard similarity differ on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius_of(similarity: float, planes: int) -> int:
    """Planes that differ at a similarity, and three and a third deviations more: one pair in 2,000 differs on more."""
    p = share_of_bits(similarity)
    return ceil(planes * p + 10 / 3 * (planes * p * (1 - p)) ** 0.5)


def samples(n: int, planes: int, similarity: float) -> np.ndarray:
    """[tables, width]: the bits on which fingerprints are filed, for n of them."""
    width = max(LEAST_WIDTH, ceil(log2(max(1, n) / MEAN_BUCKET)))
    tables = ceil(MEETINGS / (1 - share_of_bits(similarity)) ** width)
    return np.argsort(np.random.default_rng(SEED).random((tables, planes)), axis=1)[:, :width]


def _keyed(prints: DataFrame, names: list[str], radius: int, bits: np.ndarray | None) -> DataFrame:
    """(key, f0, ...): a row for each table in which a fingerprint is filed; by
    blocks of its bits, or by ``bits``."""
    if bits is None:
        keys = [F.xxhash64(F.lit(t), F.col("f0").bitwiseAND(F.lit(m))) for t, m in enumerate(block_masks(radius))]
        return prints.select(F.explode(F.array(*keys)).alias("key"), *names)
    tables, width = bits.shape
    weight = np.int64(1) << np.arange(width, dtype=np.int64)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.stack([c.to_numpy() for c in part.columns], axis=1)
                own = np.unpackbits(np.ascontiguousarray(raw).view(np.uint8), axis=1, bitorder="little")
                key = np.stack([own[:, b].astype(np.int64) @ weight + (t << width) for t, b in enumerate(bits)], axis=1)
                row = pa.array(np.repeat(np.arange(len(raw)), tables))
                yield pa.record_batch([pa.array(key.ravel()), *(c.take(row) for c in part.columns)], names=["key", *names])
        give_back()

    return prints.select(*names).mapInArrow(file, "key long, " + ", ".join(f"{n} long" for n in names))


def _dealt(prints: DataFrame, names: list[str], radius: int, bits: np.ndarray | None, n: int) -> DataFrame:
    """``_keyed``, with the rows of hot buckets filed under each pair of blocks that their own is in."""
    keyed = _keyed(prints, names, radius, bits)
    if n <= HOT:
        return keyed
    some = _keyed(prints.filter(F.pmod(F.xxhash64(F.lit(SEED), *names), F.lit(SAMPLED)) == 0), names, radius, bits)
    hot = stored(some.groupBy("key").count().select("key", F.ceil(F.col("count") * SAMPLED / HOT).cast("int").alias("blocks")).filter("blocks > 1"), "simhash-hot")
    many = hot.count()
    if not many:
        return keyed
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("key", F.least(own, k), F.greatest(own, k)))
    return keyed.join(small(hot, many), "key", "left").select(F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array("key"))).alias("key"), *names)


def links(prints: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """(a, b, d): node hashes and distance of links whose components are those of all
    links between the distinct fingerprints ``prints`` (f0, ..., node), stored
    beforehand. With ``similarity``: those of the pairs that meet in a sampled bucket."""
    names = [c for c in prints.columns if c != "node"]
    n = prints.count()
    bits = None if similarity is None else samples(n, 64 * len(names), similarity)
    keyed = _dealt(prints.select(*names), names, radius, bits, n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            change = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
            child, parent = forest(np.cumsum(change), fp, radius)
            cols = [fp[child][:, i].view(np.int64) for i in range(len(names))] + [fp[parent][:, i].view(np.int64) for i in range(len(names))]
            return pa.record_batch([*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.array(distances(fp, child, parent))], names=[f"a_{n}" for n in names] + [f"b_{n}" for n in names] + ["d"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), np.stack([batch.column(1 + i).to_numpy() for i in range(len(names))], axis=1).view(np.uint64)]
            rest = [np.concatenate(x) for x in zip(rest, new)] if rest else new
            key, fp = rest
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield done(key[:whole], fp[:whole])
                rest = [key[whole:], fp[whole:]]
        if rest:
            yield done(*rest)
        give_back()

    schema = ", ".join(f"{s}_{n} long" for s in "ab" for n in names) + ", d long"
    made = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, schema)
    a, b = (node_of([F.col(f"{s}_{n}") for n in names]) for s in "ab")
    return made.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), "d").distinct()


def node_of(words: list[Column]) -> Column:
    """What stands for a fingerprint in the graph: itself, or 32 hex digits."""
    return words[0] if len(words) == 1 else F.md5(F.concat_ws(",", *words))


def distinct_prints(prints: DataFrame) -> DataFrame:
    """(f0, ..., first, node), stored: the distinct fingerprints of ``prints`` (doc_id, f0, ...) and their least doc_id."""
    names = [c for c in prints.columns if c != "doc_id"]
    return stored(prints.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", node_of([F.col(n) for n in names])), "simhash-distinct")


def components(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` (doc_id, f0, ...) with component_id: the smallest doc_id among all
    rows whose fingerprints are reachable through ``edges`` (a, b) between the nodes of
    ``distinct``. Null doc_ids take part in linking but name no component unless a
    component has no other (then null)."""
    node = node_of([F.col(c) for c in prints.columns if c != "doc_id"])
    roots = connected_components(edges)
    rooted = distinct.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    class_of = stored(rooted.join(least, "root").select("node", "component_id"), "simhash-classes")
    return prints.withColumn("node", node).join(class_of, "node").drop("node")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 3, radius: int = 2, planes: int = 64) -> DataFrame:
    """(doc_id, f0, ..., component_id) per row of ``docs`` (doc_id, text; other
    columns are ignored). Texts without words, null ones included, have
    fingerprint zero and are linked like any other. An empty table gives an
    empty result; repeated rows give repeated rows."""
    prints = stored(fingerprints(docs, shingle_words=shingle_words, planes=planes), "simhash-prints")
    distinct = distinct_prints(prints)
    return components(prints, distinct, links(distinct.drop("first"), radius))


#: Links of a text that are verified first; the others only where these leave texts apart.
FIRST_LINKS = 4
#: Links of one text whose sets meet in one task.
FAN = 4096
#: Shingles at most that come ordered by how many texts have them, after all others. For
#: that, one text in COUNTED is counted, if there are over FEW.
FREQUENT, COUNTED, FEW = 1 << 18, 8, 8192
#: Pairs of rows that are held in memory at once.
PAIRS = 1 << 20
#: Ranges of hash values in a sketch, a power of two, and the deviations below the
#: expected share of common bytes from which a pair is left out: of pairs at the
#: threshold 1 in 30,000, fewer above it.
SKETCH, SKETCH_SLACK = 512, 4.0


def _by_document(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``docs`` joined by doc_id and hash of the text with ``side`` (doc_id, h, ...), stored."""
    there = side.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), *[c for c in side.columns if c not in ("doc_id", "h")])
    return docs.join(small(there, side.count()), docs.doc_id.eqNullSafe(there["__id"]) & (F.xxhash64(docs.text) == there["__h"]), how)


def sketch(values: np.ndarray) -> bytes:
    """SKETCH bytes for ascending distinct hashes, and their number as 4 more: for each
    of as many equal ranges of hash values 0 if none lies there, else 1 to 255 by the
    least one. Of the ranges where one of two sets has a value, the share whose bytes
    are equal estimates the sets' Jaccard similarity without bias (one-permutation
    minhash: Li, Owen, Zhang 2012), but for one chance meeting in 255, which only
    keeps a pair in."""
    out = np.zeros(SKETCH, np.uint8)
    place = (values >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    least = np.flatnonzero(np.diff(place, prepend=-1))
    out[place[least]] = 1 + values[least] % np.uint64(255)
    return out.tobytes() + np.uint32(len(values)).tobytes()


def possible(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches x, y [pairs, SKETCH + 4 bytes] leave that similarity possible.
    The used ranges are a sample without repeats of the union, whose size follows from
    the sets' sizes at the similarity, so small sets have next to no deviation."""
    size = sum(np.ascontiguousarray(z[:, SKETCH:]).view(np.uint32)[:, 0].astype(np.float64) for z in (x, y))
    x, y = x[:, :SKETCH], y[:, :SKETCH]
    used = ((x | y) != 0).sum(1)
    common = ((x == y) & (x != 0)).sum(1)
    union = size / (1 + similarity)
    unseen = np.maximum(union - used, 0) / np.maximum(union - 1, 1)
    return common >= used * similarity - SKETCH_SLACK * np.sqrt(used * similarity * (1 - similarity) * unseen) - 0.5


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int, brief: Callable[[np.ndarray], bytes] = sketch, whole: bool = True) -> DataFrame:
    """(node, shingles, sketch): the distinct shingle hashes of the texts of ``wanted``
    (node, doc_id, h), null unless ``whole``, and what ``brief`` makes of them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle_words)) for t in utf8(part.column(1))]
            made = [pa.array([s.view(np.int64) if whole else None for s in sets], pa.list_(pa.int64())), pa.array(map(brief, sets), pa.binary())]
            yield pa.record_batch([part.column(0), *made], names=["node", "shingles", "sketch"])

    found = _by_document(docs.select("doc_id", "text"), wanted, "inner").select("node", "text")
    return map_texts(found, make, f"node {wanted.schema['node'].dataType.simpleString()}, shingles array<bigint>, sketch binary").dropDuplicates(["node"])


def jaccard(x: str, y: str) -> Column:
    """Of two array columns without repeats; two empty ones have 1."""
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared, F.size(x) + F.size(y) - shared), F.lit(1.0))


def _with_ends(edges: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): the ``edges`` (a, b, ...), stored, with their ends' ``column`` of
    ``sets``. What belongs to a text with many links is dealt to several tasks."""
    fans = edges.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")).filter("parts > 1")
    fans = stored(fans, "simhash-fans")
    fan = small(fans, fans.count())
    dealt = edges.join(fan, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    theirs = sets.join(fan, sets.node == fan.b, "left").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col(column).alias("y"))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col(column).alias("x")), "a").join(theirs, ["b", "part"])
    return both.select("a", "b", "x", "y")


def plausible(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), stored: the ``edges`` whose ends' sketches leave the similarity possible."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SKETCH + 4) for c in part.columns[2:])
                yield part.select(["a", "b"]).filter(pa.array(possible(x, y, similarity)))

    return stored(_with_ends(edges, sets, "sketch").mapInArrow(keep, "a string, b string"), "simhash-plausible")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the ``edges`` (a, b), stored, whose ends' ``sets`` (node, shingles) reach the similarity."""
    return _with_ends(edges, sets, "shingles").filter(jaccard("x", "y") >= similarity).select("a", "b")


def similar(docs: DataFrame, distinct: DataFrame, *, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b), stored: links between nodes of ``distinct`` whose texts have at least that Jaccard similarity."""
    planes = 64 * sum(c.startswith("f") and c != "first" for c in distinct.columns)
    candidates = stored(links(distinct.drop("first"), radius_of(similarity, planes), similarity), "simhash-candidates")
    ends = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
    wanted = stored(ends.join(distinct.select("node", "first.*"), "node"), "simhash-wanted")
    sets = stored(shingle_sets(docs, wanted, shingle_words), "simhash-sets")
    place = lambda end: F.row_number().over(Window.partitionBy(end).orderBy("d", "a", "b"))
    near = [candidates.withColumn("k", place(end)).filter(F.col("k") <= FIRST_LINKS).select("a", "b") for end in "ab"]
    check = lambda edges: verified(plausible(edges, sets, similarity), sets, similarity)
    first = stored(near[0].unionByName(near[1]).distinct(), "simhash-first")
    early = stored(check(first), "simhash-early")
    # Other candidates matter where they would join what is still apart.
    roots = stored(connected_components(early), "simhash-roots")
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    apart = candidates.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    late = check(stored(apart.join(first, ["a", "b"], "left_anti"), "simhash-apart"))
    return stored(early.unionByName(late), "simhash-similar")


# The links that buckets, radius, sketches and forests leave out


def least_shared(total: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that sets of together ``total`` share at least at that similarity;
    rounding makes it less, never more."""
    return np.ceil(total * (similarity / (1 + similarity) - 1e-9)).astype(np.int64)


def parity(values: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes by a power of two, four times their number
    or more: whether it occurs an odd number of times; and their number as 4 bytes."""
    width = max(64, 1 << (4 * len(values)).bit_length())
    odd = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes() + np.uint32(len(values)).tobytes()


def reachable(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether ``parity`` of two sets leaves that similarity possible: no more bits
    differ than there are values in one set alone (bitmap filter: Sandes, Teodoro,
    Melo 2020), so no pair that has the similarity is left out."""
    if len(x) < len(y):
        x, y = y, x
    total = int.from_bytes(x[-4:], "little") + int.from_bytes(y[-4:], "little")
    wide, width = int.from_bytes(x[:-4], "little"), 8 * (len(x) - 4)
    while width > 8 * (len(y) - 4):
        width //= 2
        wide = (wide >> width) ^ (wide & ((1 << width) - 1))
    return (wide ^ int.from_bytes(y[:-4], "little")).bit_count() <= total - 2 * int(least_shared(np.int64(total), similarity))


def frequent(docs: DataFrame, units: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and how many of ``units`` (id, first) have
    each. This decides in what order shingles come and how work is dealt, not what is found."""
    rate = COUNTED if units.count() > FEW else 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = np.concatenate([np.unique(shingle_hashes(t, shingle_words)) for t in utf8(part.column(0))])
            yield pa.record_batch([pa.array(found.view(np.int64))], names=["shingle"])

    some = units.filter(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("first.*")
    texts = _by_document(docs.select("doc_id", "text"), some, "inner").select("text")
    counted = stored(map_texts(texts, make, "shingle long").groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1"), "simhash-counted")
    least, most = 2, 0
    for times, n in sorted(map(tuple, counted.groupBy("times").count().collect()), reverse=True):
        most += n
        if most > FREQUENT:
            least = times + 1
            break
    found = counted.filter(F.col("times") >= least).toArrow()
    often, times = (np.concatenate([np.empty(0, np.int64), found[c].to_numpy()]) for c in ("shingle", "times"))
    often = often.view(np.uint64)
    order = np.argsort(often)
    return often[order], times[order] * rate


def prefixes(docs: DataFrame, units: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(key, id, root, n, left): for each of ``units`` (id, first, root) the rarest of its n
    shingles, of which any set that reaches the similarity has one, and how many come from
    there on. One that over ``HOT`` units have is dealt out in pairs of blocks."""
    often, times = frequent(docs, units, shingle_words)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle_words)) for t in utf8(part.column(2))]
            size = np.array([len(x) for x in sets], np.int64)
            whole = np.concatenate(sets)
            known = np.zeros(len(whole), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, whole), len(often) - 1)
                known = np.where(often[at] == whole, times[at], 0)
            take = np.where(size > 0, size - np.ceil(size * (similarity - 1e-9)).astype(np.int64) + 1, 0)
            first = np.cumsum(size) - size
            chosen = [f + np.argsort(known[f : f + n], kind="stable")[:k] for f, n, k in zip(first, size, take)]
            rows = np.concatenate(chosen)
            unit = np.repeat(np.arange(len(sets)), take)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take)
            blocks = np.maximum(-(-known[rows] // HOT), 1)
            row = np.repeat(np.arange(len(rows)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = part.column(0).to_numpy()[unit[row]] % blocks[row]
            pair = np.minimum(own, other) * blocks[row] + np.maximum(own, other) + 1
            key = whole[rows[row]] + np.where(blocks[row] > 1, pair, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at, n = unit[row], size[unit[row]]
            made = [pa.array(key.view(np.int64)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))]
            yield pa.record_batch([*made, pa.array(n.astype(np.int32)), pa.array((n - place[row]).astype(np.int32))], names=["key", "id", "root", "n", "left"])

    texts = _by_document(docs.select("doc_id", "text"), units.select("first.*", "id", "root"), "inner").select("id", "root", "text")
    return map_texts(texts, make, "key long, id long, root long, n int, left int")


def meeting(key: np.ndarray, unit: np.ndarray, root: np.ndarray, n: np.ndarray, left: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (greater, less) of units of one key and different roots (0: a root of its own)
    whose shingles from there on may be enough. Rows come sorted by key and root."""

    def ends(new: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]

    if not len(key):
        return
    group = np.append(True, key[1:] != key[:-1])
    own = ends(group | (root == 0) | np.append(True, root[1:] != root[:-1]))
    many = ends(group) - own
    row = np.flatnonzero(many)
    total, at = np.cumsum(many[row]), 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        m = many[row[at:end]]
        i = np.repeat(row[at:end], m)
        j = own[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        kept = (np.minimum(left[i], left[j]) >= least_shared(n[i] + n[j], similarity)) & (unit[i] != unit[j])
        a, b = unit[i[kept]], unit[j[kept]]
        yield np.maximum(a, b), np.minimum(a, b)
        at = end


def meetings(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the units of ``prefixes`` that may reach the similarity, each pair once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in meeting(*columns, similarity):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            rest = [np.concatenate(x) for x in zip(rest, new)] if rest else new
            whole = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            if whole:
                yield from done([c[:whole] for c in rest])
                rest = [c[whole:] for c in rest]
        if rest:
            yield from done(rest)
        give_back()

    return rows.repartition("key").sortWithinPartitions("key", "root").mapInArrow(compare, "a long, b long").distinct()


def remaining(docs: DataFrame, units: DataFrame, edges: DataFrame, *, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b), stored: nodes of ``units`` (s, first, node: a row per set of shingles) that
    have a link at the similarity, and that ``edges`` (a, b) leave apart: all such links."""
    roots = stored(connected_components(edges), "simhash-joined")
    rooted = units.select(F.col("s").alias("id"), "first", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("root").agg(F.count("*").alias("rows")).filter("rows > 1").select("root", F.xxhash64("root").alias("r"))
    rooted = stored(rooted.join(several, "root", "left").select("id", "first", "node", F.coalesce("r", F.lit(0)).alias("root")), "simhash-rooted")
    met = stored(meetings(prefixes(docs, rooted, shingle_words, similarity), similarity), "simhash-met")

    def of_ends(pairs: DataFrame, whole: bool) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = stored(ends.join(rooted, "id").select(F.col("id").alias("node"), "first.*"), "simhash-wanted")
        return stored(shingle_sets(docs, wanted, shingle_words, parity, whole), "simhash-sets")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [reachable(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(left, pa.bool_()))

    left = stored(_with_ends(met, of_ends(met, False), "sketch").mapInArrow(keep, "a long, b long"), "simhash-left")
    node = lambda end: rooted.select(F.col("id").alias(end), F.col("node").alias(f"n{end}"))
    found = verified(left, of_ends(left, True), similarity).join(node("a"), "a").join(node("b"), "b")
    return stored(found.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct(), "simhash-remaining")


def deduplicate(docs: DataFrame, *, shingle_words: int, similarity: float, planes: int) -> DataFrame:
    """``docs`` without near-duplicates: texts are linked whose sets of shingles have
    at least the Jaccard ``similarity``, and of each component the rows whose doc_id is
    its least stay; null comes before all others, and equal doc_ids go by a hash of
    the text. Rows with equal doc_id and equal text count as one document. Texts
    without words are one group. Removed documents are led back to ``docs`` by
    doc_id and text."""
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    prints = stored(fingerprints(named, shingle_words=shingle_words, planes=planes, id_type="struct<doc_id: bigint, h: bigint>", distinct=True), "simhash-prints")
    names = [c for c in prints.columns if c not in ("doc_id", "s")]
    units = stored(prints.groupBy(*names, "s").agg(F.min("doc_id").alias("first")).select("s", "first", node_of([F.col(n) for n in names]).alias("node")), "simhash-units")
    prints = prints.drop("s")
    distinct = distinct_prints(prints)
    edges = similar(docs, distinct, shingle_words=shingle_words, similarity=similarity)
    edges = edges.unionByName(remaining(docs, units, edges, shingle_words=shingle_words, similarity=similarity))
    found = components(prints, distinct, edges)
    gone = stored(found.filter("doc_id != component_id").select("doc_id.*").distinct(), "simhash-gone")
    return _by_document(docs, gone, "left_anti")


def hex_print(word: Column) -> Column:
    """16 lower-case hex digits of a fingerprint word."""
    return F.lpad(F.lower(F.hex(word)), 16, "0")
