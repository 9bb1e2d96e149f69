"""Scoring texts by a gated recurrent language model with a class-factored output.

The probability of a token is that of its class, given all tokens before it in
the text, times that of the token within its class. Frequent words and the end of
a text are classes of their own; all other words fall into classes by the ends of
their spelling, grouped by the company they keep. A gated recurrent unit, written
in numpy, predicts the class; it is trained by truncated backpropagation on every
training text, each partition on its own rows and the weights averaged between
rounds. Within a class, words go by their counts over the whole corpus. State is
carried from window to window, so a text of any length is scored as a whole.

Counts are exact for all words: frequent ones (a table of bounded size) are sent
to every task, all others are met by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm import textvec as tv
from semcat.plans.lineage import stored

HIDDEN = 16
CLASSES = 48
SINGLES = 16
ENDINGS = 512
COMPANY = 64
# words whose counts are sent to every task, at most (12 bytes each)
HEAD_WORDS = 1 << 19
LANES = 256
WINDOW = 16
# tokens (one byte each) that a task holds at once
HELD_TOKENS = 8_000_000
# shares of the training texts seen in each round, in sixteenths; each text is seen once
ROUNDS = ((0, 1), (1, 4), (4, 16))

START = CLASSES
END_WORD = np.uint64(0x9AE16A3B2F90404F)
END_CLASS = CLASSES - 1
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, first): every text's words and its end."""
    words = tv.Words(data, offsets, tv.NOT_SPACE)
    n = len(words.start)
    end = words.end.copy()
    signs = np.flatnonzero(_PUNCTUATION[words.data[end - 1]])
    for _ in range(3):
        signs = signs[(end[signs] - words.start[signs] > 1) & _PUNCTUATION[words.data[end[signs] - 1]]]
        end[signs] -= 1
    ending = np.zeros(n, np.uint64)
    for j in range(1, 4):
        inside = end - j >= words.start
        byte = words.data[np.maximum(end - j, 0)].astype(np.uint64)
        ending |= np.where(inside, byte, np.uint64(0)) << np.uint64(8 * j)
    ending |= (end != words.end).astype(np.uint64)
    ending = (tv.mix(ending) % np.uint64(ENDINGS)).astype(np.int32)
    # the end of each text goes behind its last word
    at = words.first[1:]
    hashes = np.insert(words.hashes(), at, END_WORD)
    return hashes, np.insert(ending, at, ENDINGS), words.first + np.arange(len(words.first))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: of words (kind 0: hash, ending) and of neighbours (kind 1: ending, company)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    company = np.zeros((ENDINGS + 1, 2 * COMPANY), np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, ending, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(word, kind="stable")
        word, ending, n = word[order], ending[order], n[order]
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        return word[start], ending[start], np.add.reduceat(n, start)

    size = 0
    for batch in batches:
        for _, _, data, offsets in tv.slices(batch.column("text")):
            word, ending, _ = _tokens(data, offsets)
            if len(word) > 1:
                left, right = ending[:-1], ending[1:]
                flat = right.astype(np.int64) * (2 * COMPANY) + left % COMPANY
                flat = np.concatenate((flat, left.astype(np.int64) * (2 * COMPANY) + COMPANY + right % COMPANY))
                company += np.bincount(flat, minlength=company.size).reshape(company.shape)
            order = np.argsort(word)
            word, ending = word[order], ending[order]
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            held.append((word[start], ending[start], np.diff(np.append(start, len(word)))))
            size += len(start)
            if size > 4_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield _counted(0, *held[0])
                    held, size = [], 0
    if held:
        yield _counted(0, *merged())
    a, b = np.nonzero(company)
    yield _counted(1, a.astype(np.uint64), b.astype(np.int32), company[a, b])


def _counted(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(a), kind, np.int32)),
            pa.array(tv.signed(a)),
            pa.array(b.astype(np.int32)),
            pa.array(n.astype(np.int64)),
        ],
        names=["kind", "a", "b", "n"],
    )


def _grouped(company: np.ndarray, k: int) -> np.ndarray:
    """The group of each ending: k-means on the square roots of its neighbours' shares."""
    mass = company.sum(axis=1)
    points = np.sqrt(company / np.maximum(mass, 1)[:, None])
    order = np.argsort(-mass, kind="stable")
    centres = [points[order[0]]]
    far = np.full(len(points), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
        centres.append(points[int((far * mass).argmax())])
    centre = np.array(centres)
    for _ in range(15):
        group = ((points[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(k):
            own = mass * (group == g)
            if own.sum():
                centre[g] = own @ points / own.sum()
    return group


@dataclass
class Vocabulary:
    """What is known of words: counts, classes and the sizes of classes."""

    head: np.ndarray  # hashes of frequent words, sorted
    head_count: np.ndarray
    head_single: np.ndarray  # class of a word that is its own class, or -1
    class_of_ending: np.ndarray
    class_total: np.ndarray  # counts and words of a class, and one for unknown words
    tokens: int
    words: int

    def classes(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Classes alone, without looking through the whole head."""
        own = np.flatnonzero((self.head_single >= 0) & (self.head_single != END_CLASS))
        kind = self.class_of_ending[ending]
        if len(own):
            at = np.minimum(np.searchsorted(self.head[own], word), len(own) - 1)
            hit = self.head[own][at] == word
            kind[hit] = self.head_single[own][at[hit]]
        return kind

    def look_up(self, word: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count or -1 if not in the head, whether the word is a class of its own)."""
        if not len(self.head):
            none = np.full(len(word), -1, np.int64)
            return self.class_of_ending[ending], none, ending == ENDINGS
        at = np.minimum(np.searchsorted(self.head, word), len(self.head) - 1)
        known = self.head[at] == word
        count = np.where(known, self.head_count[at], -1)
        single = np.where(known, self.head_single[at], -1)
        alone = (single >= 0) | (ending == ENDINGS)
        return np.where(single >= 0, single, self.class_of_ending[ending]).astype(np.uint8), count, alone


def _vocabulary(counts: DataFrame, head_words: int) -> Vocabulary:
    words = counts.filter("kind = 0").select("a", "b", "n")
    per_count = words.groupBy("n").agg(F.count("*").alias("words"))
    # how many words have a count; as few rows as there are counts
    table = per_count.toArrow().sort_by([("n", "descending")])
    n = table.column("n").to_numpy()
    many = table.column("words").to_numpy()
    fits = np.cumsum(many) <= head_words
    least = int(n[fits][-1]) if fits.any() else (int(n[0]) + 1 if len(n) else 1)
    got = words.filter((F.col("n") >= least) | (F.col("b") == ENDINGS)).toArrow()
    head = got.column("a").to_numpy().view(np.uint64)
    order = np.argsort(head)
    head, ending, count = head[order], got.column("b").to_numpy()[order], got.column("n").to_numpy()[order]
    company = np.zeros((ENDINGS + 1, 2 * COMPANY))
    rows = counts.filter("kind = 1").toArrow()
    company[rows.column("a").to_numpy(), rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    class_of_ending = np.append(SINGLES + _grouped(company[:ENDINGS], CLASSES - SINGLES - 1), END_CLASS)
    single = np.full(len(head), -1, np.int64)
    top = np.lexsort((head, -np.where(ending == ENDINGS, -1, count)))[:SINGLES]
    single[top] = np.arange(len(top))
    single[ending == ENDINGS] = END_CLASS
    total = np.ones(CLASSES)
    for row in words.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        total[class_of_ending[row["b"]]] += row["n"] + row["words"]
    for i in np.flatnonzero((single >= 0) & (ending != ENDINGS)):
        total[class_of_ending[ending[i]]] -= count[i] + 1
    total[:SINGLES] = total[END_CLASS] = 1
    return Vocabulary(
        head, count, single, class_of_ending.astype(np.uint8), total,
        int((n * many).sum()), int(many.sum()),
    )


@dataclass
class Network:
    """Weights of the recurrent unit: gates update, reset and new state, in this order."""

    embedding: np.ndarray  # class before (or START) to the gates
    recurrent: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return Network(
            draw(CLASSES + 1, 3 * HIDDEN, scale=0.3),
            draw(HIDDEN, 3 * HIDDEN, scale=0.25),
            draw(HIDDEN, CLASSES, scale=0.25),
            np.zeros(CLASSES, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.recurrent, self.output, self.output_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of_flat(flat: np.ndarray) -> "Network":
        like, parts, at = Network.fresh().parts(), [], 0
        for p in like:
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*parts)

    def states(self, before: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states of a window of ``before`` (steps, lanes), and the last; ``keep`` gets the gates."""
        steps, lanes = before.shape
        out = np.empty((steps, lanes, HIDDEN), np.float32)
        H = HIDDEN
        for t in range(steps):
            x = self.embedding[before[t]]
            h = h * (before[t] != START)[:, None]
            g = h @ self.recurrent
            gates = x[:, : 2 * H] + g[:, : 2 * H]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :H], gates[:, H:]
            n = np.tanh(x[:, 2 * H :] + r * g[:, 2 * H :])
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * H :]))
            h = n + z * (h - n)
            out[t] = h
        return out, h

    def log_shares(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(logits) and their sums, for rows of states."""
        e = states @ self.output
        e += self.output_bias
        np.clip(e, -60, 60, out=e)
        np.exp(e, out=e)
        return e, e.sum(axis=1)


def _in_lanes(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class or START where there is none, number of text) by step and lane.

    Longest texts first, each to the lane that is free first.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lanes = min(lanes, len(texts))
    free = [(0, lane) for lane in range(lanes)]
    places: list[tuple[int, int]] = [(0, 0)] * len(texts)
    for i in order:
        used, lane = heapq.heappop(free)
        places[i] = (used, lane)
        heapq.heappush(free, (used + len(texts[i]), lane))
    steps = max(used for used, _ in free)
    steps += -steps % WINDOW
    before = np.full((lanes, steps), START, np.uint8)
    now = np.full((lanes, steps), START, np.uint8)
    owner = np.zeros((lanes, steps), np.int32)
    for i, (at, lane) in enumerate(places):
        text = texts[i]
        now[lane, at : at + len(text)] = text
        before[lane, at + 1 : at + len(text)] = text[:-1]
        owner[lane, at : at + len(text)] = i
    return (np.ascontiguousarray(x.T) for x in (before, now, owner))


def _scores(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each text's classes."""
    before, now, owner = _in_lanes(texts, LANES)
    h = np.zeros((before.shape[1], HIDDEN), np.float32)
    scores = np.zeros(len(texts))
    for a in range(0, len(before), WINDOW):
        states, h = network.states(before[a : a + WINDOW], h)
        wanted = now[a : a + WINDOW].ravel()
        e, total = network.log_shares(states.reshape(-1, HIDDEN))
        there = np.flatnonzero(wanted != START)
        share = e[there, wanted[there]] / total[there]
        scores += np.bincount(owner[a : a + WINDOW].ravel()[there], np.log10(share.astype(np.float64)), len(texts))
    return scores


def _learn(network: Network, seen: list[np.ndarray], texts: list[np.ndarray], rate: float) -> int:
    """One pass over the texts, by AdaGrad on windows of truncated backpropagation; the number of tokens."""
    before, now, _ = _in_lanes(texts, LANES)
    lanes = before.shape[1]
    h = np.zeros((lanes, HIDDEN), np.float32)
    H, parts = HIDDEN, network.parts()
    for a in range(0, len(before), WINDOW):
        x, y = before[a : a + WINDOW], now[a : a + WINDOW]
        keep: list = []
        states, h = network.states(x, h, keep)
        rows = states.reshape(-1, H)
        wanted = y.ravel()
        e, total = network.log_shares(rows)
        there = wanted != START
        e /= total[:, None]
        at = np.flatnonzero(there)
        e[at, wanted[at]] -= 1
        e[~there] = 0
        e *= np.float32(1 / max(len(at), 1))
        d_output, d_bias = rows.T @ e, e.sum(axis=0)
        d_states = (e @ network.output.T).reshape(len(x), lanes, H)
        d_gates = np.empty((len(x), lanes, 3 * H), np.float32)
        d_back = np.empty((len(x), lanes, 3 * H), np.float32)
        h_before = np.empty((len(x), lanes, H), np.float32)
        d_h = np.zeros((lanes, H), np.float32)
        for t in range(len(x) - 1, -1, -1):
            was, z, r, n, g_new = keep[t]
            d_h = d_h + d_states[t]
            keeps = 1 - z
            d_n = d_h * keeps * (1 - n * n)
            d_z = d_h * (was - n) * z * keeps
            d_r = d_n * g_new * r * (1 - r)
            d_gates[t, :, :H], d_gates[t, :, H : 2 * H], d_gates[t, :, 2 * H :] = d_z, d_r, d_n
            d_back[t] = d_gates[t]
            d_back[t, :, 2 * H :] *= r
            h_before[t] = was
            d_h = (d_h * z + d_back[t] @ network.recurrent.T) * (x[t] != START)[:, None]
        d_recurrent = h_before.reshape(-1, H).T @ d_back.reshape(-1, 3 * H)
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        sorted_x = flat[order]
        start = np.flatnonzero(np.concatenate(([True], sorted_x[1:] != sorted_x[:-1])))
        d_embedding = np.zeros_like(network.embedding)
        d_embedding[sorted_x[start]] = np.add.reduceat(d_gates.reshape(-1, 3 * H)[order], start, axis=0)
        for p, g, s in zip(parts, (d_embedding, d_recurrent, d_output, d_bias), seen):
            np.clip(g, -1, 1, out=g)
            s += g * g
            p -= rate * g / np.sqrt(s)
    return int(sum(map(len, texts)))


def _held(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, summed, then) -> Iterator:
    """Batches' texts as classes, handed to ``then(texts, sums)`` a bounded number of tokens at a time.

    ``summed``, if given, makes of each looked-up slice what is kept of it besides its classes.
    """
    texts: list[np.ndarray] = []
    sums: list = []
    size = 0
    for batch in batches:
        for a, b, data, offsets in tv.slices(batch.column("text")):
            word, ending, first = _tokens(data, offsets)
            if summed:
                kind, count, alone = vocabulary.look_up(word, ending)
                sums.append(summed(batch.slice(a, b - a), word, kind, count, alone, first))
            else:
                kind = vocabulary.classes(word, ending)
            texts += [kind[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            size += len(word)
            if size > HELD_TOKENS:
                yield from then(texts, sums)
                texts, sums, size = [], [], 0
    if texts:
        yield from then(texts, sums)


def _trained(vocabulary, network, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of_flat(network.value)
        seen = [np.full_like(p, 1e-4) for p in own.parts()]
        tokens = 0

        def then(texts, _):
            nonlocal tokens
            tokens += _learn(own, seen, texts, rate)
            return ()

        for _ in _held(batches, vocabulary.value, None, then):
            pass
        if tokens:
            flat = own.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * tokens), pa.array(np.full(len(flat), tokens, np.int64))],
                names=["i", "weighted", "tokens"],
            )

    return run


_SCORED = "row bigint, n_tokens bigint, n_known bigint, logs double, classes double, rare array<bigint>"


def _scored(vocabulary, network, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = vocabulary.value, Network.of_flat(network.value)
        log_total = np.log10(words.class_total)
        row = TaskContext.get().partitionId() << 36

        def summed(batch, word, kind, count, alone, first):
            n = len(first) - 1
            text = np.repeat(np.arange(n), np.diff(first))
            known = count >= 0
            logs = np.bincount(text[known], np.log10(count[known] + 1.0), n)
            # within a class of one word nothing is left to tell
            single = known & alone
            inside = np.bincount(text[single], np.log10(count[single] + 1.0), n)
            shares = np.bincount(text, np.where(alone, 0.0, log_total[kind]), n)
            rare = ~known & ~alone
            ends = np.concatenate(([0], np.cumsum(np.bincount(text[rare], minlength=n))))
            return (
                batch.select(["doc_id", "held_out"]),
                np.diff(first),
                np.bincount(text[known], minlength=n),
                logs,
                -inside - shares,
                pa.ListArray.from_arrays(ends.astype(np.int32), tv.signed(word[rare])),
            )

        def then(texts, rows):
            nonlocal row
            classes = _scores(own, texts)
            at = 0
            for batch, n_tokens, n_known, logs, rest, rare in rows:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(np.arange(row, row + n)),
                        pa.array(n_tokens.astype(np.int64)),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(logs),
                        pa.array(classes[at : at + n] + rest),
                        rare,
                    ],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_known", "logs", "classes", "rare"],
                )
                at, row = at + n, row + n

        yield from _held(batches, words, summed, then)

    return run


def score(
    docs: DataFrame,
    held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Log10 probabilities of all whole texts, learned from the rows where ``held_out`` (a condition) is false.

    One row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (add-one counts of tokens alone) and ``score``. Tokens are
    words between white space, with A-Z lower-cased, and the end of the text.

    Null and empty texts are their end alone. Repeated rows are scored alike, null ids kept. Without any
    training text the model is the untrained one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64(id_col), F.lit(16)).alias("_turn"),
    )
    learned = rows.filter("not held_out")
    counts = stored(
        learned.select("text").mapInArrow(_count, "kind int, a bigint, b int, n bigint")
        .groupBy("kind", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
    known = _vocabulary(counts, head_words)
    vocabulary = spark.sparkContext.broadcast(known)
    flat = Network.fresh().flat()
    for turn, (a, b) in enumerate(ROUNDS):
        network = spark.sparkContext.broadcast(flat)
        means = (
            learned.filter((F.col("_turn") >= a) & (F.col("_turn") < b))
            .select("text")
            .mapInArrow(_trained(vocabulary, network, 0.1 / (1 + turn)), "i int, weighted double, tokens bigint")
            .groupBy("i")
            .agg((F.sum("weighted") / F.sum("tokens")).alias("w"))
            .toArrow()  # as many rows as the network has weights
        )
        if means.num_rows:
            flat = means.sort_by("i").column("w").to_numpy().astype(np.float32)
    network = spark.sparkContext.broadcast(flat)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = stored(
        rows.select("doc_id", "held_out", "text").mapInArrow(
            _scored(vocabulary, network, id_type), f"doc_id {id_type}, held_out boolean, {_SCORED}"
        )
    )
    rare = (
        scored.select("row", F.explode("rare").alias("a"))
        .join(counts.filter("kind = 0").select("a", "n"), "a")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1.0)).alias("_logs"), F.count("*").alias("_known"))
    )
    logs = F.col("logs") + F.coalesce("_logs", F.lit(0.0))
    base = float(np.log10(known.tokens + known.words + 1))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (logs + F.col("classes")).alias("score"),
    )
