"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are runs of lower-cased letters with one blank between them; their n-grams
of two and three characters are hashed into a fixed number of buckets. Training
counts buckets by language in one pass over all training texts. The matrix of log
probabilities is broadcast (its size is buckets times languages), and a batch is
scored by adding up the rows of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.llm import textvec as tv
from semcat.llm.rows import with_arrays

BUCKET_BITS = 16
SMOOTHING = 0.1
# n-grams of a text that count as evidence for its score, at most; long texts are not surer than sure
EVIDENCE = 50
UNKNOWN = "und"
_BUCKETS = 1 << BUCKET_BITS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For characters of the first plane: lower case (0 where it is no letter)."""
    lower = np.zeros(0x10001, np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            lower[c] = ord(y) if len(y) == 1 else c
    lower[0x10000] = 0x10000  # beyond it, all characters are one letter
    return lower


_LOWER: list[np.ndarray] = []


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, has a letter) of a slice's n-grams, text after text."""
    if not _LOWER:
        _LOWER.append(_tables())
    is_first = (data & 0xC0) != 0x80
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(is_first)))[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    chars = _LOWER[0][np.minimum(chars, 0x10000)]
    letters = np.concatenate((np.zeros(1, np.int64), np.cumsum(chars != 0)))
    has_letter = letters[at[1:]] > letters[at[:-1]]
    # every text begins and ends with a blank; of blanks in a row one is kept
    chars = np.insert(chars, at[1:], 0)
    chars = np.concatenate((np.zeros(1, np.uint32), chars))
    border = at + np.arange(len(at))  # the blank before each text
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0)
    keep[border] = True
    where = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    # one more blank, so that the last text has all its pairs
    chars, border = np.append(chars[keep], 0).astype(np.uint64), where[border]
    a, b, c = chars[:-2], chars[1:-1], chars[2:]
    two = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ c * np.uint64(0x94D049BB133111EB)
    shift = np.uint64(64 - BUCKET_BITS)
    pair = np.stack((two * np.uint64(0xD6E8FEB86659FD93) >> shift, three * np.uint64(0xD6E8FEB86659FD93) >> shift), axis=1)
    # three characters from the last one of a text on would reach into the next text
    inside = np.ones((len(a), 2), bool)
    inside[border[1:] - 1, 1] = False
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(inside.sum(axis=1))))
    starts = first[np.minimum(border, len(a))]
    return pair[inside].astype(np.int64), starts, has_letter


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task; bucket -1 counts texts."""
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        for a, b, data, offsets in tv.slices(batch.column("text")):
            bucket, first, has_letter = _ngrams(data, offsets)
            names = lang[a:b]
            ids = {name: i for i, name in enumerate(dict.fromkeys(names))}
            owner = np.repeat([ids[x] for x in names], np.diff(first))
            flat = np.bincount(owner * _BUCKETS + bucket, minlength=len(ids) * _BUCKETS)
            for name, i in ids.items():
                counts[name] = counts.get(name, 0) + flat[i * _BUCKETS : (i + 1) * _BUCKETS]
            for name, letter in zip(names, has_letter.tolist()):
                texts[name] = texts.get(name, 0) + letter
    for name, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (len(some) + 1), pa.string()),
                pa.array(np.append(some, -1).astype(np.int32)),
                pa.array(np.append(n[some], texts[name]).astype(np.int64)),
            ],
            names=["lang", "bucket", "n"],
        )


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # bucket by language

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for _, _, data, offsets in tv.slices(column):
            bucket, first, has_letter = _ngrams(data, offsets)
            n = len(has_letter)
            known = has_letter & bool(self.languages)
            total = np.tile(self.prior, (n, 1))
            size = np.diff(first)
            some = np.flatnonzero(size)
            if len(some) and self.languages:
                total[some] += np.add.reduceat(self.weights[bucket], first[some], axis=0)
            best = total.argmax(axis=1) if self.languages else np.zeros(n, int)
            sure = total * np.minimum(1, EVIDENCE / np.maximum(size, 1))[:, None]
            if self.languages:
                share = np.exp(sure - sure.max(axis=1, keepdims=True))
                share = share[np.arange(n), best] / share.sum(axis=1)
            else:
                share = np.zeros(n)
            names += [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
            scores.append(np.where(known, share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of ``docs`` that have a language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counts = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most buckets times languages rows
    lang, bucket, n = (got.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    languages = sorted(str(x) for x, b, m in zip(lang, bucket, n) if b == -1 and m > 0)
    weights = np.full((_BUCKETS, len(languages)), SMOOTHING)
    texts = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = lang == name
        texts[i] = n[own & (bucket == -1)].sum()
        some = own & (bucket >= 0)
        weights[bucket[some], i] += n[some]
    prior = np.log(texts / max(texts.sum(), 1)) if languages else np.zeros(0)
    return Model(languages, prior, np.log(weights / weights.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from whole texts alone.

    A null text and one without a letter get ``und`` and 0, as does every text if
    nothing was learned. Equal sums go to the first language by name. Columns
    named as the new ones are replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        names, scores = shared.value.predict(column)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_arrays(docs, text_col, {"lang_pred": T.StringType(), "score": T.DoubleType()}, run)
