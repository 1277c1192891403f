"""Secret scan: base patterns, and guess costs of values in credential contexts.

A password's guess cost is the least, over all ways to cut it into words,
dates, repeats, keyboard walks and brute-force spans, of the product of the
parts' guesses. The dynamic program goes through the value once: a part ends at
each place and begins at most ``LONGEST`` characters before, but for runs of one
character and brute-force spans, which are carried along and may be any length.
A value in a credential context, that is after the keyword and ``:`` or ``=``, or a
long one after ``bearer``, whose cost reaches ``10 ** THRESHOLD`` guesses is reported
with kind ``guess``.

The words are common password words, plain words that stand after such keywords in prose,
then the ``VOCABULARY`` words of the corpus itself that occur in most classes of texts,
by counting all of it. A text's class is that of its least hashed word, so copies and nearly all
near copies are of one class; a word counts once per class, words inside a credential context
don't count, and a word of fewer than ``LEAST_CLASSES`` isn't one. So a leaked value
stays costly however often its document is copied.

Values that go on as code or an address does (a call, an index, names joined by dots, ``://``
without a password) are no credentials.

An automaton first tells which texts can hold anything; those are searched
whole. Only word counts are shuffled, and long texts stay with their row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, text_slices

THRESHOLD = 8.0
LONGEST = 24
#: Size of the dictionary, the classes of texts that a word must be in, of CLASSES, and words
#: that a task counts at once.
VOCABULARY, LEAST_CLASSES, CLASSES, COUNTED = 30_000, 24, 256, 500_000

# Base kinds in their order, with the group and length that a match needs.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# Of the runs AKIA[A-Z0-9]+ and [0-9a-f]+ only long ones count; a run's first
# match is its longest, so asking for the length in the pattern gives the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: For an automaton: a text without a match here has none of the above or below.
MAY_HOLD = r"(?i)pass|pwd|secret|token|(api|access|private)[_-]?key|credential|auth|bearer|AKIA|[0-9a-f]{24}"
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|auth(?:orization)?)["']?\x20*[:=]\x20*["']?(?:(?i:bearer|basic)\x20+)?([^\s"'<>,;]{6,})|(?i:\bbearer)\x20+([A-Za-z0-9._~+/=-]{16,})""",
    re.ASCII,
)

# Common password words by rank, keyboard rows, letters written as other characters.
WORDS = (
    "password admin welcome login master secret dragon monkey letmein shadow sunshine princess football baseball superman "
    "michael jennifer jordan hunter ranger buster thomas robert soccer batman test pass charlie andrew love killer pepper "
    "joshua maggie ginger summer winter spring autumn hello freedom computer internet orange cookie silver golden banana "
    "cheese flower purple yellow green black white blue red happy angel money access server root user guest default change "
    "system oracle mysql azure cloud token private public example sample demo temp dev prod stage data team work home"
).split()
# Fixed value: plain words of prose and headings after credential keywords.
PLAIN_WORDS = (
    "access account accepted according active administration administrator advanced agency agent agreement allowed another application applications approval approved "
    "authentication authorities authority authorization authorized automatic available bearer because before business canceled certificate certificates certification changed "
    "character characters client code collection commission committee community company complete confidential configuration confirmed connection contains control corporation "
    "council country create credential credentials customer daily database deleted department description details different digital director disabled division document documents "
    "economy education electronic empty enabled encrypted encryption enter every example expired external federal field file following forgot forgotten future gathering general "
    "generated government granted group hidden history however identification identity important incorrect individual information initial instead institute instructions insurance "
    "international internationalization invalid issued justice key known language leader letters license located logged management manager manual meeting member message minimum "
    "ministry missing mixed mountains mushrooms must name national necessary needed never none number numbers office officer official operation optional order organization other "
    "outside owner panel paper parameter payment people permission personal phone phrase please policy position possible private procedure process program project property protected "
    "protection provided public question random ready reason recovery regional registration remember reminder report request required requirement requirements reset resource response "
    "restricted result review role rules safety saved school section secure security send sent service services session setting settings shared should signature simple single social "
    "society some source special standard state statement status stored strength string strong support system temporary test text their there these this through title transfer type "
    "undefined unique university unknown update updated used user users valid value values verification verified version village website weak when where which with without word words "
    "world writer written wrong year years your zone"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("0134578@$!", "oieastbasi")

_WALKS = {(a, b) for r in ROWS for a, b in zip(r + r[::-1], (r + r[::-1])[1:]) if a != b}
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: A date's guesses: days of 120 years, times ways to write one; a year's.
_DATE_COST, _YEAR_COST, _WALK_COST = log10(120 * 365 * 4), log10(120), log10(2 * sum(map(len, ROWS)))


def _brute(c: str) -> float:
    if c.isascii():
        return log10(10) if c.isdigit() else log10(26) if c.isalpha() else log10(33)
    return log10(1000)


class Words:
    """Words by rank, those of passwords first."""

    def __init__(self, corpus: Iterable[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys((*WORDS, *PLAIN_WORDS, *corpus)))}
        self.lengths = sorted({len(w) for w in self.rank})

    def cost(self, part: str, low: str, plain: str) -> float | None:
        """Rank, times the ways to write it in capitals and look-alikes."""
        rank = self.rank.get(low)
        swaps = 0
        if not rank:
            rank = self.rank.get(plain)
            if not rank:
                return None
            swaps = sum(a != b for a, b in zip(low, plain))
        upper = sum(map(str.isupper, part))
        case = 0.0 if not upper else log10(2) if upper in (1, len(part)) else upper * log10(2)
        return log10(rank + 1) + case + swaps * log10(2)


PLAIN = Words()
#: What a value that is code or an address looks like.
_CODE = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*[(\[{]|[A-Za-z_$]{1,24}(?:(?:\.|->|::)[A-Za-z_$]{1,24})+\W*\Z|[A-Za-z][A-Za-z0-9+.-]*://(?![^/\s]*:[^/\s]*@)|\$\{|\{\{|%\(", re.ASCII)


def _classes(part: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, rows): the words (3 to LONGEST letters a-z, in lower case) of the texts that
    stand outside credential contexts, and for each the classes it is in as bits of bytes."""
    may = pc.fill_null(pc.match_substring_regex(part, MAY_HOLD), False)
    outside = iter([CONTEXT.sub(" ", ASSIGN.sub(" ", t)) for t in part.filter(may).to_pylist()])
    texts = pa.array([next(outside) if m else t for m, t in zip(may.to_pylist(), part.to_pylist())], pa.string()) if pc.any(may).as_py() else part
    listed = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^a-z]+")
    coded, row = listed.flatten().dictionary_encode(), pc.list_parent_indices(listed).to_numpy()
    words, code = coded.dictionary, coded.indices.to_numpy()
    size = pc.binary_length(words).to_numpy()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    fits = ((size >= 3) & (size <= LONGEST))[code]
    code, row = code[fits], row[fits]
    if not len(code):
        return pa.array([], pa.string()), np.empty((0, CLASSES // 8), np.uint8)
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(hashed[code], at)
    own = np.repeat((least % np.uint64(CLASSES)).astype(np.int64), np.diff(np.r_[at, len(row)]))
    pair = np.unique(code.astype(np.int64) * CLASSES + own)
    used, place = np.unique(pair // CLASSES, return_inverse=True)
    bits = np.zeros((len(used), CLASSES), bool)
    bits[place, pair % CLASSES] = True
    return words.take(pa.array(used)), np.packbits(bits, axis=1)


def corpus_words(docs: DataFrame, most: int = VOCABULARY, least: int = LEAST_CLASSES) -> list[str]:
    """The ``most`` words that occur in most classes of the texts of ``docs`` (text), in
    ``least`` at least; ties by the alphabet. Exact copies change nothing."""
    lanes = CLASSES // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def made() -> pa.RecordBatch:
            rows = np.stack(list(total.values())).view(np.int64) if total else np.empty((0, lanes), np.int64)
            return pa.record_batch([pa.array(list(total), pa.string()), *(pa.array(rows[:, k]) for k in range(lanes))], names=["word", *(f"c{k}" for k in range(lanes))])

        for part in text_slices(batches):
            words, rows = _classes(part.column(0))
            for w, r in zip(words.to_pylist(), rows):
                total[w] = total[w] | r if w in total else r
            if len(total) > COUNTED:
                yield made()
                total.clear()
        yield made()

    names = [f"c{k}" for k in range(lanes)]
    counted = map_texts(docs.select("text"), count, "word string, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*[F.bit_or(c).alias(c) for c in names])
    in_classes = sum((F.bit_count(c) for c in names[1:]), F.bit_count(names[0]))
    return [r.word for r in counted.withColumn("n", in_classes).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def guess_cost(value: str, enough: float = float("inf"), words: Words = PLAIN) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; where the
    cost is sure to reach ``enough``, some number of at least that."""
    n = len(value)
    cost = [0.0] + [float("inf")] * n
    joint = log10(2)  # each part but the first: where it begins
    run = walk = 0  # places where the current run of one character, and walk, began
    run_best = brute_best = 0.0  # least cost before the run; cost of the open brute-force span
    # One character each, so that places stay.
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    dates = {}
    for at in range(n):
        if value[at].isdigit() and (m := _DATE.match(value, at)):
            dates.setdefault(m.end(), []).append((at, _YEAR_COST if m.end() - at == 4 else _DATE_COST))
    for j in range(1, n + 1):
        c = value[j - 1]
        before = cost[j - 1] + (joint if j > 1 else 0.0)
        brute_best = _brute(c) + (min(brute_best, before) if j > 1 else before)
        best = brute_best
        if j == 1 or value[j - 2] != c:
            run, run_best = j - 1, before
        elif j - run >= 3:
            best = min(best, run_best + _brute(c) + log10(j - run))
        if j > 1 and (low[j - 2], low[j - 1]) not in _WALKS:
            walk = j - 1
        for i in range(max(walk, j - LONGEST), j - 2):
            turns = log10(j - i)
            best = min(best, cost[i] + (joint if i else 0.0) + _WALK_COST + turns)
        for k in words.lengths:
            if k > j:
                break
            if (w := words.cost(value[j - k : j], low[j - k : j], plain[j - k : j])) is not None:
                best = min(best, cost[j - k] + (joint if j > k else 0.0) + w)
        for i, d in dates.get(j, ()):
            best = min(best, cost[i] + (joint if i else 0.0) + d)
        cost[j] = best
        # Whatever follows begins at one of these places or goes on with an open part.
        if min(brute_best, run_best) >= enough and min(cost[max(0, j - LONGEST) : j + 1]) >= enough:
            return enough
    return cost[n]


def spans(text: str, threshold: float = THRESHOLD, words: Words = PLAIN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind number, end) by start and kind, and guess spans (start, end)."""
    base = sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)
    found = [m.span(m.lastindex) for m in CONTEXT.finditer(text) if not _CODE.match(text, m.start(m.lastindex), m.end(m.lastindex))]
    guess = [(a, b) for a, b in found if guess_cost(text[a:b], threshold, words) >= threshold]
    return base, guess


def scan(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_assign, n_access, n_hex, base_sha256,
    spans, n_guess. Spans are whole matches (guess: the value) in code points as
    kind:start:end, by start, then kind as listed, joined with commas. Null text
    is empty: no spans, the digest of nothing. Repeated rows repeat; an empty
    table gives no rows. Words are counted over all of ``docs``."""
    words = docs.sparkSession.sparkContext.broadcast(Words(corpus_words(docs)))  # VOCABULARY words, about 2 MB
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    none = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
    kinds = [k for k, *_ in BASE]

    def row(text: str) -> tuple:
        base, guess = spans(text, threshold, words.value)
        digest = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        every = sorted(base + [(s, len(kinds), e) for s, e in guess])
        said = ",".join(f"{[*kinds, 'guess'][k]}:{s}:{e}" for s, k, e in every)
        count = [sum(k == x for _, k, _ in base) for x in range(len(kinds))]
        return (*count, hashlib.sha256(digest.encode()).hexdigest(), said, len(guess))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            may = pc.fill_null(pc.match_substring_regex(part.column(1), MAY_HOLD), False).to_numpy(zero_copy_only=False)
            rows = [none] * part.num_rows
            for i in may.nonzero()[0].tolist():
                rows[i] = row(part.column(1)[i].as_py())
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[c.split()[0] for c in schema.split(", ")])

    return map_texts(docs.select("doc_id", "text"), find, schema)
