"""License scan by an exact set-similarity join.

Text blocks and license templates are sets of words. Blocks are all runs of words as
long as a template (longer by 1 / ``threshold``), whatever line ends they pass; so words of
a template that are scattered over a long line make no match. A block matches a template
if it contains at least ``threshold`` of the template's words, and for templates under
``ORDERED`` words in the template's order. The join is exact and filters first, whole
texts before their blocks:

* tokens are ordered by their frequency over all documents, rare ones first;
* prefix: a match must hold one of the template's first
  ``|T| - needed + 1`` tokens in that order, so only those are indexed;
* length: a block with fewer distinct words than needed can't match;
* positional: going through a template's tokens in order, the places that
  remain bound the overlap that is still possible.

Templates given as pairs are a program's own list: each task holds their prefix index,
texts stream past it and nothing but counts is shuffled. A table of templates may be of any
size: its prefix words meet the texts' words in a join, behind a bit set of fixed size that
keeps words of no prefix from the shuffle, and each pair that this leaves is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, stored, text_slices, utf8

Templates = tuple[tuple[str, str], ...]

# Base phrases with their labels, and opening sentences of license
# texts with the labels that the method adds.
BASE: Templates = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES: Templates = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
THRESHOLD = 0.9
#: Bits of the set that holds the prefix words of a table of templates.
BITS = 1 << 20
#: Templates of a table that a task keeps ready.
READY = 4096

#: Templates with fewer words than this are matched in order.
ORDERED = 10

#: Folds bytes: A-Z to lower case, bytes of words (all non-ASCII ones are) to
#: themselves, others to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Index:
    """Prefix index of the templates under a global order of tokens."""

    tokens: list[list[bytes]]  # of each template, rare ones first
    needed: list[int]
    labels: list[str]
    prefix: dict[bytes, list[int]]  # token: templates
    words: list[list[bytes]]  # of each template, as they stand
    width: list[int]  # words in a run that may match
    threshold: float

    @classmethod
    def build(cls, templates: Templates, threshold: float, frequency: dict[bytes, int]) -> Index:
        tokens = [sorted(set(text.encode().translate(_FOLD).split()), key=lambda w: (frequency.get(w, 0), w)) for _, text in templates]
        needed = [max(1, ceil(threshold * len(t) - 1e-9)) for t in tokens]
        prefix: dict[bytes, list[int]] = {}
        for i, (t, k) in enumerate(zip(tokens, needed)):
            for w in t[: len(t) - k + 1]:
                prefix.setdefault(w, []).append(i)
        words = [text.encode().translate(_FOLD).split() for _, text in templates]
        width = [ceil(len(w) / threshold - 1e-9) for w in words]
        return cls(tokens, needed, [label for label, _ in templates], prefix, words, width, threshold)

    def overlap(self, i: int, block: set[bytes]) -> int:
        """Shared tokens with template i; 0 as soon as the places passed leave too few."""
        t, missing = self.tokens[i], len(self.tokens[i]) - self.needed[i]
        for w in t:
            if w not in block:
                missing -= 1
                if missing < 0:
                    return 0
        return self.needed[i] + missing

    def matches(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) for each template that the block contains."""
        for i in {i for w in block & self.prefix.keys() for i in self.prefix[w]}:
            if len(block) >= self.needed[i] and (shared := self.overlap(i, block)):
                yield i, shared / len(self.tokens[i])

    def best_run(self, i: int, words: list[bytes]) -> float:
        """Containment of template i in the run of words that holds most of it, in order if
        the template is short; 0 if too little."""
        whole = self.words[i]
        least = max(1, ceil(self.threshold * len(whole) - 1e-9))
        own, width = set(self.tokens[i]), self.width[i]
        places = [p for p, w in enumerate(words) if w in own]
        inside: Counter[bytes] = Counter()
        first = most = in_order = 0
        for p in places:
            inside[words[p]] += 1
            while places[first] <= p - width:
                w = words[places[first]]
                inside[w] -= 1
                if not inside[w]:
                    del inside[w]
                first += 1
            most = max(most, len(inside))
            if len(whole) < ORDERED and len(inside) >= self.needed[i]:
                in_order = max(in_order, _common_length(whole, words[max(0, p - width + 1) : p + 1]))
        if len(whole) < ORDERED:
            return in_order / len(whole) if in_order >= least else 0.0
        return most / len(own) if most >= self.needed[i] else 0.0


def _common_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _counted(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """(word, n): how often each word, or each of the vocabulary, occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            total: Counter[bytes] = Counter()
            for raw in utf8(part.column(0)):
                own = Counter(raw.translate(_FOLD).split())
                for w in own if vocabulary is None else vocabulary & own.keys():
                    total[w] += own[w]
            yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return map_texts(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of a program's own templates occurs in all texts."""
    return {bytes(r.word): r.n for r in _counted(docs, vocabulary).collect()} if vocabulary else {}  # at most a row per word


# A table of templates


def _folded(templates: DataFrame) -> DataFrame:
    """(tid, label, words) of the distinct templates that have a label and a word."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = [(label, b" ".join(raw.translate(_FOLD).split())) for label, raw in zip(part.column(0).to_pylist(), utf8(part.column(1)))]
            rows = [(md5(label.encode() + b"\0" + words).digest(), label, words) for label, words in rows if words]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.binary()))], names=["tid", "label", "words"])

    sound = templates.filter("label is not null and text is not null").select("label", "text")
    return map_texts(sound, fold, "tid binary, label string, words binary").dropDuplicates(["tid"])


def _prefixes(folded: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(word, tid, needed) of each template's prefix words in the order of their frequency."""
    words = folded.select("tid", F.explode(F.array_distinct(F.split(F.col("words").cast("string"), " "))).alias("w")).select("tid", F.col("w").cast("binary").alias("word"))
    order = words.join(counts, "word", "left").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("order"))
    size = F.size("order")
    needed = F.greatest(F.lit(1), F.ceil(size * F.lit(threshold) - 1e-9)).cast("int")
    return order.select("tid", needed.alias("needed"), F.explode(F.slice("order", F.lit(1), size - needed + 1)).alias("o")).select("o.word", "tid", "needed")


def _matches(docs: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(key, labels, score) of the texts of ``docs`` (key, text) in which a template of the table stands."""
    folded = stored(_folded(templates), "license-templates")
    prefixes = stored(_prefixes(folded, _counted(docs), threshold), "license-prefixes")
    bits = np.zeros(BITS, bool)
    bits[[r.b for r in prefixes.select((F.crc32("word") % BITS).alias("b")).distinct().collect()]] = True  # at most BITS numbers

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = []
            for key, raw in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                own = set(raw.translate(_FOLD).split())
                rows += [(key, w, len(own)) for w in own if bits[crc32(w) % BITS]]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int32()))], names=["key", "word", "size"])

    met = map_texts(docs.select("key", "text"), words, "key string, word binary, size int").distinct().join(prefixes, "word").filter("size >= needed")
    pairs = stored(met.select("key", "tid").distinct(), "license-pairs")
    texts = docs.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    each = pairs.join(folded, "tid").join(texts, "key").select("key", "label", "words", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = lru_cache(READY)(lambda words: Index.build((("", words.decode()),), threshold, {}))
        for part in text_slices(batches):
            rows = []
            for key, label, own, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), utf8(part.column(3))):
                index, text = ready(own), raw.translate(_FOLD).split()
                if index.overlap(0, set(text)) and (share := index.best_run(0, text)):
                    rows.append((key, label, share))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["key", "label", "score"])

    # A text's distinct labels are its result.
    return map_texts(each, verify, "key string, label string, score double").groupBy("key").agg(F.collect_set("label").alias("found"), F.max("score").alias("most"))


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands in words that single spaces part and enclose."""
    out, needle = [], b" " + phrase + b" "
    at, seen, passed = joined.find(needle), 0, 0
    while at >= 0:
        passed += joined.count(b" ", seen, at)
        seen = at
        out.append(passed)
        at = joined.find(needle, at + 1)
    return out


def scan_text(raw: bytes, index: Index, base: list[tuple[bytes, str]]) -> tuple:
    """(words, base places, first and last of them, base labels, all labels, score)."""
    plain = raw.translate(_FOLD)
    words = plain.split()
    places, found, joined = [], set(), b""
    for phrase, label in base:
        if all(w in plain for w in phrase.split()):
            joined = joined or b" %b " % b" ".join(words)
            if at := _places(joined, phrase):
                found.add(label)
                places += at
    labels, score = set(found), 1.0 if found else 0.0
    for i, _ in index.matches(set(words)):
        if share := index.best_run(i, words):
            labels.add(index.labels[i])
            score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, *, templates: Templates | DataFrame = TEMPLATES, threshold: float = THRESHOLD, base: Templates = BASE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word,
    base_labels, labels, score. The score is 1 where a base phrase stands, else
    the largest containment of a template in a run of words that meets the threshold, or 0.
    Null text is empty: no words, no labels. Repeated rows repeat; an empty
    table gives no rows. A label is given once however often it is found. ``templates``
    as a table of any size: (label, text), of which rows without either or without a word say
    nothing; a label holds no comma. Both forms give the same rows."""
    if isinstance(templates, DataFrame):
        keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
        found = _matches(keyed.select("key", "text"), templates, threshold)
        plain = _scan(keyed, Index.build((), threshold, {}), base)
        every = F.array_sort(F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("found", F.array().cast("array<string>"))))
        both = plain.join(found, "key", "left").withColumns({"labels": F.array_join(every, ","), "score": F.greatest("score", F.coalesce("most", F.lit(0.0)))})
        return both.select(*[c for c in plain.columns if c != "key"])
    vocabulary = frozenset(w for _, text in templates for w in text.encode().translate(_FOLD).split())
    return _scan(docs.select("doc_id", "text"), Index.build(templates, threshold, frequencies(docs, vocabulary)), base)


def _scan(docs: DataFrame, index: Index, base: Templates) -> DataFrame:
    """The result's columns of each row of ``docs`` (doc_id, text, others), the others after them."""
    phrases = [(phrase.encode(), label) for phrase, label in base]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    others = docs.columns[2:]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = [scan_text(raw, index, phrases) for raw in utf8(part.column(1))]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.record_batch([part.column(0), *made, *part.columns[2:]], names=[*(c.split()[0] for c in schema.split(", ")), *others])

    return map_texts(docs, find, ", ".join([schema, *(f"{c} string" for c in others)]))
