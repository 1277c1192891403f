"""Language identification with string kernels.

A text is the set of its character n-grams of 1 to ``MAX_N`` characters
(presence, not counts), hashed to ``BUCKETS``. The kernel of two texts is the
blended-spectrum presence kernel, normalized by the geometric mean of the set
sizes. Nyström landmarks turn it into finite features, on which one-versus-rest
kernel ridge regression is solved. As the kernel is linear in the presence
vector, landmarks, whitening and regression fold into one weight matrix, and
texts are scored as a batch: presence matrix times weights.

Only the fit is sampled: at most ``PER_LANGUAGE`` documents of each language and
about ``FIT_ROWS`` in all, those with the least hash of doc_id and text, whole
texts. Every document is predicted from its whole text. There is no limit to the
number of languages; a model takes 256 kB for each and is scored a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_texts, text_slices

MAX_N = 3
BUCKETS = 1 << 15
#: Bounds of the fit: labelled documents per language and, down to LEAST of each, in all;
#: landmarks in all, down to 2 of each language.
PER_LANGUAGE, LEAST, FIT_ROWS = 400, 8, 25_600
LANDMARKS = 256
#: Texts whose presence vectors make one matrix, and languages scored at once.
ROWS, COLUMNS = 64, 64
#: Text bytes scored at once.
BYTES = 1 << 20
RIDGE = 1e-2
#: A language knows the n-grams that this share of its fitted texts hold. A text fits it
#: if the share of known ones among its n-grams is at least SLACK times what all but
#: STRAY of the fitted texts reach, each measured by the others.
KNOWN, SLACK, STRAY = 0.02, 0.8, 0.02
UNKNOWN = "und"

_MIX = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    """Whether there is a character of a letter category (L); number signs aren't."""
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str, present: np.ndarray) -> None:
    """Sets ``present`` (BUCKETS floats) to 1 at the hashes of the n-grams."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(x), np.uint32)
    for n in range(MAX_N):
        if len(x) <= n:
            break
        h = h[: len(x) - n] * np.uint32(31) + x[n:] + np.uint32(n + 1)
        present[(h * _MIX) >> np.uint32(32 - 15)] = 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    known: np.ndarray  # BUCKETS x languages: 1 where the language knows the n-gram
    floor: np.ndarray  # the least share of known n-grams, by language

    def score(self, texts: list[str | None], *, fitting: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, a score in [0, 1] for each text, and, if ``fitting`` is asked
        for, whether some language knows enough of its n-grams (else false); ``und``, 0
        and false if null, without a letter, or if no language was learned."""
        out, scores, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        buffer = np.zeros((min(ROWS, len(rows)), BUCKETS), np.float32)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            matrix = buffer[: len(some)]
            matrix[:] = 0
            for k, i in enumerate(some):
                grams(texts[i], matrix[k])
            count = matrix.sum(1, keepdims=True)
            raw = np.concatenate([matrix @ self.weights[:, k : k + COLUMNS] for k in range(0, len(self.languages), COLUMNS)], axis=1) / np.sqrt(count) + self.bias
            best = raw.argmax(1)
            for k, i in enumerate(some):
                out[i] = self.languages[best[k]]
            scores[some] = np.clip((raw[np.arange(len(some)), best] + 1) / 2, 0, 1)
            if fitting:
                known = np.concatenate([matrix @ self.known[:, k : k + COLUMNS] for k in range(0, len(self.languages), COLUMNS)], axis=1)
                fits[some] = (known / count >= self.floor).any(1)
        return out, scores, fits


def fit(packed: list[bytes], labels: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression (targets 1 and -1) on Nyström features. ``packed``:
    BUCKETS presence bits for each labelled text, unpacked a few at a time."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    label = np.array(labels)
    marks = unit(np.concatenate([np.flatnonzero(label == lang)[: max(2, landmarks // len(languages))] for lang in languages]))
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    sound = value > 1e-6 * value[-1]
    white = vector[:, sound] / np.sqrt(value[sound])
    z = np.concatenate([(unit(rows) @ marks.T).astype(np.float64) for rows in np.array_split(np.arange(len(label)), -(-len(label) // 128))]) @ white
    y = np.where(label[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = np.array([1 / (label == lang).sum() for lang in languages])[np.searchsorted(languages, label)]
    balance = balance / balance.mean()
    z_mean, y_mean = np.average(z, axis=0, weights=balance), np.average(y, axis=0, weights=balance)
    zc = z - z_mean
    beta = np.linalg.solve(zc.T @ (zc * balance[:, None]) + ridge * np.eye(z.shape[1]), zc.T @ ((y - y_mean) * balance[:, None]))
    known, floor = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = [np.flatnonzero(np.unpackbits(np.frombuffer(packed[i], np.uint8))) for i in np.flatnonzero(label == lang)]
        held = np.bincount(np.concatenate(own), minlength=BUCKETS)
        known[:, k] = held >= max(1, KNOWN * len(own))
        share = [(held[x] - 1 >= max(1, KNOWN * (len(own) - 1))).mean() if len(x) else 0.0 for x in own]
        floor[k] = SLACK * np.quantile(share, STRAY)
    return Model(languages, (marks.T @ (white @ beta)).astype(np.float32), y_mean - z_mean @ beta, known, floor)


def train(docs: DataFrame, usable: Column) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) that are ``usable``
    and have a language. Sampling is by the least hash of doc_id and text within
    each language, equal rows counting once; presence vectors of 4 kB go to the
    driver, PER_LANGUAGE per language and about FIT_ROWS in all at most."""
    order = F.xxhash64(F.lit(7), F.col("doc_id").cast("string"), F.col("text"))
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().collect()  # a row per language, as the model's columns
    most = max(LEAST, min(PER_LANGUAGE, FIT_ROWS // max(1, len(counts))))
    # Twice the share wanted of the hash range: the rows are few, their number is bounded below.
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 2 * most / r["count"]) * (1 << 53))) for r in counts], "lang string, share long")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            bits = []
            for text in part.column(2).to_pylist():
                present = np.zeros(BUCKETS, np.float32)
                grams(text, present)
                bits.append(np.packbits(present.astype(bool)).tobytes())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(bits, pa.binary())], names=["o", "lang", "bits"])

    sample = labelled.join(F.broadcast(shares), "lang").filter(F.shiftrightunsigned(order, 11) < F.col("share"))
    # Texts become bits where they are read; only these are shuffled.
    made = map_texts(sample.select(order.alias("o"), "lang", "text"), features, "o long, lang string, bits binary").dropDuplicates(["o", "lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "bits"))
    rows = made.withColumn("rank", rank).filter(F.col("rank") <= most).orderBy("lang", "rank").collect()
    return fit([r.bits for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model, *, column: str = "text", keep: list[str] | None = None, only_fitting: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) with lang_pred and score, from
    the whole text alone; ``only_fitting``: of the rows that fit some language of the
    model. An empty table gives an empty result."""
    keep = docs.columns if keep is None else keep
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    spark_model = docs.sparkSession.sparkContext.broadcast(model)  # 256 kB per language
    # The text goes to the workers once.
    sent = keep if column in keep else [*keep, column]
    at = sent.index(column)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column, BYTES):
            lang, value, fits = spark_model.value.score(part.column(at).to_pylist(), fitting=only_fitting)
            made = pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(value)], names=[*keep, "lang_pred", "score"])
            yield made.filter(pa.array(fits)) if only_fitting else made

    return map_texts(docs.select(*sent), score, schema)


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text,
    lang). Learns from rows that are not held out and have a language; lang,
    source and doc_id are never inputs of a prediction. Null text or text
    without a letter: ``und``, 0; so all, if nothing is labelled. Repeated
    rows repeat; ties between languages go to the first in order."""
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs, ~held_out()), keep=["doc_id", "held_out"])
