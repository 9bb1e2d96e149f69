"""Quality classifier: a factorisation machine over hashed words and structure.

A text is a sparse vector: its words, hashed and weighted by log counts of unit
length, and a few shares that tell its structure and size. The score adds a
weight for each feature and one for each pair, as the inner product of two short
vectors; the sum over all pairs is half of (square of the sum minus sum of the
squares), so a text is scored in time linear in its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.llm import textvec as tv
from semcat.llm.rows import fold, with_arrays

BUCKET_BITS = 15
RANK = 8
# labelled rows that the model is fitted on, at most: those of the least hash
SAMPLE_ROWS = 6000
EPOCHS = 6
BATCH = 256

_BUCKETS = 1 << BUCKET_BITS


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(characters)] = 1
    return table


_CLASSES = {
    "capitals": _class(bytes(range(0x41, 0x5B))),
    "digits": _class(b"0123456789"),
    "symbols": _class(b"#*$%&|<>"),
    "marks": _class(b"!?;:=_{}[]()/\\~^@\"+"),
    "beyond_ascii": _class(bytes(range(0x80, 0x100))),
}
STRUCTURE = [*_CLASSES, "word_length", "distinct_words", "same_as_before", "lines", "size"]
FEATURES = _BUCKETS + len(STRUCTURE)


def featurised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, feature, value): each text's features; null and empty texts have only structure."""
    firsts, features, values = [np.zeros(1, np.int64)], [], []
    total = 0
    for _, _, data, offsets in tv.slices(column):
        n = len(offsets) - 1
        words = tv.Words(data, offsets, tv.NOT_SPACE)
        hashes = words.hashes()
        text = np.repeat(np.arange(n), words.count)
        pair = np.sort(text << BUCKET_BITS | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        start = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
        pair_text, bucket = pair[start] >> BUCKET_BITS, pair[start] & (_BUCKETS - 1)
        weight = np.log1p(np.diff(np.append(start, len(pair))))
        norm = np.sqrt(np.bincount(pair_text, weight * weight, n))
        weight = weight / norm[pair_text]
        size = np.diff(offsets)
        at_least = np.maximum(size, 1)
        n_words = np.maximum(words.count, 1)
        shape = []
        for table in _CLASSES.values():
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(table[data], dtype=np.int64)))
            shape.append((sums[offsets[1:]] - sums[offsets[:-1]]) / at_least)
        letters = np.bincount(text, words.end - words.start, n)
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        newlines = np.concatenate((np.zeros(1, np.int64), np.cumsum(data == 0x0A, dtype=np.int64)))
        shape += [
            np.tanh(letters / n_words / 20),
            np.bincount(pair_text, minlength=n) / n_words,
            np.bincount(text, same, n) / n_words,
            np.tanh((newlines[offsets[1:]] - newlines[offsets[:-1]]) / n_words * 10),
            np.log1p(size) / 12,
        ]
        feature = np.concatenate((bucket, np.tile(np.arange(len(shape)) + _BUCKETS, n)))
        value = np.concatenate((weight, np.stack(shape, axis=1).ravel()))
        owner = np.concatenate((pair_text, np.repeat(np.arange(n), len(shape))))
        order = np.argsort(owner, kind="stable")
        features.append(feature[order].astype(np.int32))
        values.append(value[order].astype(np.float32))
        ends = np.cumsum(np.bincount(owner, minlength=n))
        firsts.append(ends + total)
        total += len(feature)
    if not features:
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(firsts), np.concatenate(features), np.concatenate(values)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        if len(first) == 1:
            return np.zeros(0)
        linear = np.add.reduceat(self.weights[feature] * value, first[:-1])
        part = self.factors[feature] * value[:, None]
        total = np.add.reduceat(part, first[:-1], axis=0)
        squares = np.add.reduceat(part * part, first[:-1], axis=0)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        raw = self.raw(*featurised(column)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _gather(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients summed by feature."""
    order = np.argsort(index, kind="stable")
    index, grad = index[order], grad[order]
    start = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    return index[start], np.add.reduceat(grad, start, axis=0)


def fit(first: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, by AdaGrad over small batches; one class alone gives its smoothed share."""
    rng = np.random.default_rng(seed)
    share = (target.sum() + 1) / (len(target) + 2)
    bias = float(np.log(share / (1 - share)))
    weights = np.zeros(FEATURES, np.float32)
    factors = rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)
    if len(np.unique(target)) < 2:
        return Model(bias, weights, np.zeros_like(factors))
    seen_w = np.full(FEATURES, 1e-6, np.float32)
    seen_v = np.full((FEATURES, RANK), 1e-6, np.float32)
    for epoch in range(EPOCHS):
        rate = 0.2 / (1 + epoch)
        order = rng.permutation(len(target))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            count = first[rows + 1] - first[rows]
            begin = np.concatenate(([0], np.cumsum(count)))
            take = np.arange(begin[-1]) + np.repeat(first[rows] - begin[:-1], count)
            index, x = feature[take], value[take]
            model = Model(bias, weights, factors)
            p = 1 / (1 + np.exp(-np.clip(model.raw(begin, index, x), -30, 30)))
            g = ((p - target[rows]) / len(rows)).astype(np.float32)
            bias -= rate * float(g.sum())
            each = np.repeat(g, count) * x
            part = factors[index] * x[:, None]
            total = np.repeat(np.add.reduceat(part, begin[:-1], axis=0), count, axis=0)
            i, dw = _gather(index, each)
            _, dv = _gather(index, each[:, None] * (total - part))
            dw += 1e-5 * weights[i]
            dv += 1e-4 * factors[i]
            seen_w[i] += dw * dw
            seen_v[i] += dv * dv
            weights[i] -= rate * dw / np.sqrt(seen_w[i])
            factors[i] -= 0.3 * rate * dv / np.sqrt(seen_v[i])
    return Model(bias, weights, factors)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows, in one pass over the texts.

    Only ids whose crc32 (of the id as text) mod 3 is not 1 are learned from.
    Rows without an id or a quality of 0 or 1 are left out; a row labelled twice
    counts once for each of its labels.
    """
    wanted = (
        labels.filter(F.col(quality_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1))
        .select(F.col("doc_id").alias("_id"), F.col(quality_col).cast("int").alias("_target"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_target")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(wanted), "_id")
    # texts that come twice count once, so that the sample keeps its bound
    rows = rows.groupBy("_id", "_target").agg(F.min("_text").alias("_text"))
    rows = rows.select(F.col("_id").cast("string").alias("_id"), "_target", "_text")

    def features(column: pa.Array) -> list[pa.Array]:
        first, feature, value = featurised(column)
        first = first.astype(np.int32)
        return [pa.ListArray.from_arrays(first, feature), pa.ListArray.from_arrays(first, value)]

    fields = {"_feature": T.ArrayType(T.IntegerType()), "_value": T.ArrayType(T.FloatType())}
    got = with_arrays(rows, "_text", fields, features).toArrow()
    # an order that does not hang on which task came first
    got = got.sort_by([("_id", "ascending"), ("_target", "ascending")]).combine_chunks()
    first, flat = np.zeros(1, np.int64), {}
    for name, kind in (("_feature", np.int32), ("_value", np.float32)):
        parts = [x for x in got.column(name).chunks]
        flat[name] = np.concatenate([np.zeros(0, kind), *[x.flatten().to_numpy() for x in parts]])
        count = np.concatenate([np.zeros(0, np.int64), *[np.diff(x.offsets.to_numpy()) for x in parts]])
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    target = got.column("_target").to_numpy().astype(np.float32)
    return fit(first, flat["_feature"], flat["_value"].astype(np.float32), target)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, of being good) and ``predicted`` (1 from one half on).

    Every whole text is scored from its words and structure alone; null and empty
    texts get the score of an empty text. Columns named as the new ones are
    replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        score = shared.value.score(column)
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]

    return with_arrays(docs, text_col, {"score": T.DoubleType(), "predicted": T.IntegerType()}, run)
