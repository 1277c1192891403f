"""Alignment of two tokenizers' ids over the same bytes, as an Arrow pipeline.

A batch's texts are cut into units that neither vocabulary's tokens cross (a word with
the space or line feed before it; a text with odd white space is one unit), and
each distinct unit is encoded once. Its two lists of ids are flattened with their parent
indices, segmented cumulative sums of the tokens' byte lengths give their ends, and an
Acero hash join on (unit, end) keys tells where both end. The outer join's rows, in
order, are the pieces between neighbouring ends of either side, each within one token of
A and one of B; and two tokens that overlap share exactly one piece. So pieces are links.

Links of id pairs are counted by ``Table.group_by`` in each task and merged by Spark. A
second pass looks the counts up. The table of counts goes to the tasks whole if it has at most
``PAIRS`` rows; beyond, documents' pairs meet it by a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, map_texts, stored, text_slices
from .bytebpe import ODD, ByteEncoder, bounds, byte_of_letter, chunked, gathered

#: Rows of the table of counts that are broadcast at most, 17 bytes each.
PAIRS = 4_000_000
#: Pairs that a task counts before it gives them on.
COUNTED = 1_000_000
#: A key is (unit, end): this many bits for the end.
_BITS = 32
_SPACE = "▁"
#: Texts whose pieces might reach over a cut.
_ODD_B = rf"  |^[ \n]|[ \n]\z|{_SPACE}"


def _list(flat: np.ndarray | pa.Array, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat if isinstance(flat, pa.Array) else pa.array(flat))


def _join(flat: pa.Array, at: np.ndarray, mark: str | bytes) -> pa.Array:
    return pc.binary_join(_list(flat, at), mark)


class Pieces:
    """Ids of a sentencepiece model, which adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        code = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := code.fullmatch(p)) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id(_SPACE)
        begin = self.model.encode("\nx")
        #: Whether no piece reaches over a cut: none has a space after another letter, or a line feed.
        self.cuts = all(_SPACE not in p.lstrip(_SPACE) and "\n" not in p for p in pieces) and begin[:1] == [self.space] and self.model.encode("a a")[0] == self.model.encode("a")[0]

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, where each unit's begin); a unit begins with a space or a line
        feed, of which the model's own space isn't part, or is empty."""
        own = self.model.encode([u[1:] if u[:1] == " " else u for u in units], num_threads=1)
        for k, u in enumerate(units):
            if u == " ":
                own[k] = [self.space]
            elif u[:1] == "\n":
                own[k] = own[k][1:]
        at = bounds(np.fromiter(map(len, own), np.int64, len(own)))
        return np.fromiter((i for ids in own for i in ids), np.int32, at[-1]), at


@dataclass
class Slice:
    """Some documents' alignment. ``unit`` lists the units of all documents in a row, those
    of document i from ``at[i]`` on; ``links`` is (unit, a, b), by unit."""

    unit: np.ndarray
    at: np.ndarray
    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.Array
    links: pa.Table

    def per_document(self, of_unit: np.ndarray) -> np.ndarray:
        """Sums over a document's units; 0 for documents that aren't sound."""
        total = bounds(of_unit[self.unit])
        return np.where(self.sound, total[self.at[1:]] - total[self.at[:-1]], 0)

    def per_unit(self, of_link: np.ndarray) -> np.ndarray:
        link_unit = self.links["unit"].to_numpy()
        total = bounds(of_link)
        edge = np.searchsorted(link_unit, np.arange(len(self.n_a) + 1))
        return total[edge[1:]] - total[edge[:-1]]

    def digests(self) -> list[str]:
        has = self.n_groups[self.unit] > 0  # an empty unit adds no group
        kept = self.groups.take(pa.array(self.unit[has]))
        said = _join(kept, bounds(has)[self.at], ";").cast(pa.binary())
        return [hashlib.sha256(x).hexdigest() if ok else "" for x, ok in zip(said.to_pylist(), self.sound.tolist())]

    def occurrences(self) -> np.ndarray:
        """How often each unit occurs in sound documents."""
        in_sound = np.repeat(self.sound, self.at[1:] - self.at[:-1])
        return np.bincount(self.unit[in_sound], minlength=len(self.n_a))


class Aligner:
    """Aligns texts under a byte-level vocabulary (A) and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteEncoder(path_a, specials=False), Pieces(path_b)
        letters = byte_of_letter()
        of_id = {n: t for t, n in self.a.tokenizer.get_vocab(with_added_tokens=True).items()}
        own = [of_id.get(i, "") for i in range(max(of_id) + 1)]
        self.bytes_a = pa.array([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in own], pa.binary())
        self.bytes_b = pa.array(self.b.bytes, pa.binary())
        self.cuts = self.a.ranked is not None and self.b.cuts

    def slice(self, texts: pa.Array) -> Slice:
        given = pc.fill_null(pc.not_equal(texts, ""), False)
        texts = pc.if_else(given, pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), "")
        own = pc.utf8_slice_codeunits(texts, 1)
        odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.match_substring_regex(own, _ODD_B)) if self.cuts else given
        cut = chunked(pc.if_else(odd, "", texts))
        coded = cut.flatten().dictionary_encode()
        units, unit = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        a, a_at = self.a.chunks(units)
        b, b_at = self.b.units(units.to_pylist())
        at = bounds(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(which):
            whole = texts.take(pa.array(which))
            more, then = self.a.whole(whole.to_pylist())
            a, a_at = np.concatenate([a, more]), np.concatenate([a_at, a_at[-1] + then[1:]])
            more, then = self.b.units(whole.to_pylist())
            b, b_at = np.concatenate([b, more]), np.concatenate([b_at, b_at[-1] + then[1:]])
            # A text that was set to '' for the cut has one unit, the empty one.
            unit[at[which]] = len(units) + np.arange(len(which))
            units = pa.concat_arrays([units, whole])
        raw = units.cast(pa.binary())
        true = [pc.equal(_join(table.take(pa.array(flat)), ends, b""), raw) for table, flat, ends in ((self.bytes_a, a, a_at), (self.bytes_b, b, b_at))]
        lossless = pc.and_(*true).to_numpy(zero_copy_only=False)
        a, a_at = _only(a, a_at, lossless)
        b, b_at = _only(b, b_at, lossless)
        lost = bounds(~lossless[unit])
        sound = given.to_numpy(zero_copy_only=False) & (lost[at[1:]] == lost[at[:-1]])
        links, group, groups = self._units(a, a_at, b, b_at)
        return Slice(unit, at, sound, np.diff(a_at), np.diff(b_at), group, groups, links)

    def _ends(self, flat: np.ndarray, at: np.ndarray, table: pa.Array, name: str) -> pa.Table:
        """(key, id) of each token, the key being its unit and the byte where it ends."""
        listed = _list(flat.astype(np.int32), at)
        parent, ids = pc.list_parent_indices(listed), pc.list_flatten(listed)
        size = pc.binary_length(table).take(ids).cast(pa.int64())
        total = pc.cumulative_sum(size)
        before = bounds(size.to_numpy())[at[:-1]]
        end = pc.subtract(total, pa.array(before).take(parent))
        return pa.table({"key": pc.bit_wise_or(pc.shift_left(parent.cast(pa.int64()), _BITS), end), name: ids})

    def _units(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[pa.Table, np.ndarray, pa.Array]:
        """Links, and per unit the number of its groups and their text."""
        n = len(a_at) - 1
        ends = self._ends(a, a_at, self.bytes_a, "a").join(self._ends(b, b_at, self.bytes_b, "b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        key, ia, ib = (ends[c].combine_chunks() if ends.num_rows else pa.array([], ends.schema.field(c).type) for c in ("key", "a", "b"))
        unit = pc.shift_right(key, _BITS)
        # The token over a piece is the one that ends next; both sides end with the unit.
        links = pa.table({"unit": unit, "a": pc.fill_null_backward(ia), "b": pc.fill_null_backward(ib)})
        both = pc.and_(pc.is_valid(ia), pc.is_valid(ib))
        count = np.bincount(unit.filter(both).to_numpy(), minlength=n)
        sides = []
        for ids in (ia, ib):
            mine = pc.is_valid(ids)
            ended = np.flatnonzero(both.filter(mine).to_numpy(zero_copy_only=False)) + 1
            sides.append(_join(ids.filter(mine).cast(pa.string()), np.r_[0, ended], ","))
        return links, count, _join(pc.binary_join_element_wise(*sides, "|"), bounds(count), ";")


def _only(flat: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists, those that aren't kept emptied."""
    if keep.all():
        return flat, at
    size = np.where(keep, np.diff(at), 0)
    return gathered(flat, at, np.flatnonzero(keep))[0], bounds(size)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner for two vocabulary files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def pair_counts(docs: DataFrame, *, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n, best): links of all documents by id pair, and whether no pair of that
    ``b`` has more. A task's rows are counted before they go on, so a frequent pair is
    one row per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(waiting).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

        for part in text_slices(batches, limit=SLICE_BYTES):
            got = aligner(path_a, path_b).slice(part.column(0))
            n = pa.array(got.occurrences()).take(got.links["unit"].combine_chunks())
            table = got.links.select(["a", "b"]).append_column("n", n).filter(pc.greater(n, 0))
            waiting.append(table.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"]))
            if sum(t.num_rows for t in waiting) > COUNTED:
                waiting = [merged()]
                if waiting[0].num_rows > COUNTED // 2:
                    yield from waiting.pop().to_batches()
        if waiting:
            yield from merged().to_batches()

    counted = map_texts(docs.select("text"), count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Of one b there are as many rows at most as A has ids.
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
_NAMES = ["n_a", "n_b", "n_groups", "n_links"]


def _columns(part: pa.RecordBatch, got: Slice) -> list[pa.Array]:
    """doc_id, the counts and groups_sha256."""
    of_unit = (got.n_a, got.n_b, got.n_groups, got.per_unit(np.ones(got.links.num_rows, np.int64)))
    return [part.column(0), *(pa.array(got.per_document(x)) for x in of_unit), pa.array(got.digests(), pa.string())]


def align(docs: DataFrame, *, path_a: str, path_b: str, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) per row of
    ``docs`` (doc_id, text; other columns are ignored). Texts that are null, empty or not given
    back by both vocabularies have no tokens: zeros and ''. Repeated rows count as
    often as they come; an empty table gives no rows."""
    counts = stored(pair_counts(docs, path_a=path_a, path_b=path_b), "alignment-pairs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if counts.count() > most_pairs:
        return _by_join(docs, counts, kind, path_a, path_b)
    table = counts.toArrow()
    key = _key(table["a"].to_numpy(), table["b"].to_numpy())
    order = np.argsort(key)
    held = docs.sparkSession.sparkContext.broadcast((key[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for part in text_slices(batches, limit=SLICE_BYTES):
            got = aligner(path_a, path_b).slice(part.column(1))
            # A pair that only documents without tokens have isn't counted.
            at = np.minimum(np.searchsorted(keys, link := _key(got.links["a"].to_numpy(), got.links["b"].to_numpy())), max(0, len(keys) - 1))
            known = keys[at] == link if len(keys) else np.zeros(len(link), bool)
            of_link = [np.where(known, x[at], 0) if len(keys) else np.zeros(len(link), np.int64) for x in (best.astype(np.int64), n)]
            yield pa.record_batch([*_columns(part, got), *(pa.array(got.per_document(got.per_unit(x))) for x in of_link)], names=["doc_id", *_NAMES, "groups_sha256", "n_best", "count_sum"])

    return map_texts(docs.select("doc_id", "text"), look, f"doc_id {kind}, {_COUNTS}, groups_sha256 string, n_best long, count_sum long")


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << _BITS | b.astype(np.int64)


def _by_join(docs: DataFrame, counts: DataFrame, kind: str, path_a: str, path_b: str) -> DataFrame:
    """``align`` by a join of each document's distinct pairs with the counts, which
    adaptive execution splits where a pair is frequent."""

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SLICE_BYTES):
            got = aligner(path_a, path_b).slice(part.column(1))
            doc = np.repeat(np.where(got.sound, np.arange(part.num_rows), -1), np.diff(got.at))
            held = pa.table({"doc": doc, "unit": got.unit}).filter(pc.greater_equal(pa.array(doc), 0))
            pairs = held.join(got.links, "unit", join_type="inner", use_threads=False).group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
            at = np.searchsorted(pairs["doc"].to_numpy(), np.arange(part.num_rows + 1))
            rows = [pairs[c].combine_chunks() if pairs.num_rows else pa.array([], pairs.schema.field(c).type) for c in ("a", "b", "count_all")]
            links = pa.StructArray.from_arrays([rows[0].cast(pa.int32()), rows[1].cast(pa.int32()), rows[2].cast(pa.int64())], names=["a", "b", "times"])
            yield pa.record_batch([*_columns(part, got), _list(links, at)], names=["doc_id", *_NAMES, "groups_sha256", "pairs"])

    found = map_texts(docs.select("doc_id", "text"), list_pairs, f"doc_id {kind}, {_COUNTS}, groups_sha256 string, pairs array<struct<a:int,b:int,times:long>>")
    made = stored(found.withColumn("uid", F.monotonically_increasing_id()), "alignment-documents")
    asked = made.select("uid", F.inline("pairs")).join(counts, ["a", "b"])
    sums = asked.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return made.drop("pairs").join(sums, "uid", "left").select("doc_id", *_NAMES, "groups_sha256", none("n_best"), none("count_sum"))
