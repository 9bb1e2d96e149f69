"""Fill-in-the-middle: texts cut at two token borders and put in another order.

A cut is named by its rank among a text's token borders. The borders of a slice of
texts are kept as a learned index from rank to byte offset: straight segments,
each within a fixed error of every offset it covers, and one small stored residual
per border. A cut is predicted by its segment and corrected by its residual, which
gives the exact offset. Segments are found greedily, each as long as some line
through its first border stays within the error of all its borders.

The index takes one byte a border where the offsets themselves take eight, and one
index serves all seeds, as when every epoch cuts the same texts elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.llm import textvec as tv

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
# how far a segment may be from an offset; residuals then fit into one byte
ERROR = 120
# borders looked at in one step when a segment is extended
STEP = 4096


@dataclass
class RankIndex:
    """From the rank of a border to its offset."""

    first: np.ndarray  # rank of each segment's first border
    start: np.ndarray  # its offset
    slope: np.ndarray
    residual: np.ndarray  # one byte a border

    @staticmethod
    def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments over all ``offsets``, which do not fall."""
        n, at = len(offsets), 0
        first, start, slope = [], [], []
        residual = np.zeros(n, np.int8)
        while at < n:
            low, high, end = -np.inf, np.inf, at + 1
            while end < n:
                # slopes that stay within the error of all borders up to each one
                x = np.arange(end - at, min(end + STEP, n) - at, dtype=np.float64)
                y = (offsets[end : end + len(x)] - offsets[at]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((y - error) / x), low)
                highs = np.minimum(np.minimum.accumulate((y + error) / x), high)
                bad = np.flatnonzero(lows > highs)
                fits = int(bad[0]) if len(bad) else len(x)
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                end += fits
                if fits < len(x):
                    break
            line = 0.0 if end == at + 1 else (low + high) / 2
            rank = np.arange(end - at)
            residual[at:end] = offsets[at:end] - offsets[at] - np.rint(line * rank).astype(np.int64)
            first.append(at)
            start.append(offsets[at])
            slope.append(line)
            at = end
        return RankIndex(np.array(first, np.int64), np.array(start, np.int64), np.array(slope), residual)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of these ranks."""
        segment = np.searchsorted(self.first, ranks, "right") - 1
        predicted = self.start[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)
        return predicted + self.residual[ranks]


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all token borders of a slice, and each text's number of tokens.

    A token is a word with the white space before it; white space at the end of a text is one more.
    A text of n tokens has n + 1 borders, its start included.
    """
    word = tv.NOT_SPACE[data]
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[:-1] = word[:-1] & ~word[1:]
        # what ends a text ends a token
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    at = np.flatnonzero(ends) + 1
    n = np.searchsorted(at, offsets[1:], "right") - np.searchsorted(at, offsets[:-1], "right")
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)[:-1])) if len(n) else n
    return np.insert(at, before, offsets[:-1]), n


def _formed(seeds: tuple[int, ...], fim_rate: int, spm_rate: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tv.slices(batch.column("_text")):
                part = batch.slice(a, b - a)
                marks, n = borders(data, offsets)
                index = RankIndex.fit(marks)
                base = np.cumsum(n + 1) - (n + 1)
                texts = [data[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                cut = np.array([bool(t) and not any(s.encode() in t for s in SENTINELS) for t in texts], bool)
                for k in range(len(seeds)):
                    h1, h2, h3, h4 = (part.column(f"_h{k}_{i}").to_numpy() for i in range(4))
                    one, two = h1 % (n + 1), h2 % (n + 1)
                    p = index.offsets(base + np.minimum(one, two)) - offsets[:-1]
                    m = index.offsets(base + np.maximum(one, two)) - offsets[:-1]
                    moved = cut & (h3 % 100 < fim_rate)
                    spm = h4 % 100 < spm_rate
                    out, form, n_prefix, n_middle = [], [], [], []
                    for t, x, y, is_moved, is_spm in zip(texts, p.tolist(), m.tolist(), moved.tolist(), spm.tolist()):
                        if not is_moved:
                            out.append(t)
                            form.append(PLAIN)
                            n_prefix.append(None)
                            n_middle.append(None)
                            continue
                        prefix, middle, suffix = t[:x], t[x:y], t[y:]
                        if is_spm:
                            out.append(b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle))
                        else:
                            out.append(b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle))
                        form.append(SPM if is_spm else PSM)
                        n_prefix.append(_chars(data[offsets[len(out) - 1] :][:x]))
                        n_middle.append(_chars(data[offsets[len(out) - 1] + x :][: y - x]))
                    made = [
                        pa.array([seeds[k]] * len(out), pa.int64()),
                        pa.array(n.astype(np.int64)),
                        pa.array(form, pa.string()),
                        pa.array(n_prefix, pa.int64()),
                        pa.array(n_middle, pa.int64()),
                        pa.array(out, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in names] + made,
                        names=names + ["_seed", "_n", "_form", "_prefix", "_middle", "_out"],
                    )
        tv.give_back()

    return run


def _chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 from a row's seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seeds: tuple[int, ...] = (42,),
    fim_rate: int = 50,
    spm_rate: int = 80,
) -> DataFrame:
    """``docs`` once for each seed, its text column replaced by a struct ``fim``.

    ``fim`` holds ``seed, n, form, prefix_chars, middle_chars, text``; :func:`restored` gives the old text
    back. ``n`` is the number of tokens, ``form`` is ``plain``, ``psm`` or ``spm``, ``text`` the row's training
    text. ``fim_rate`` in 100 rows are cut, ``spm_rate`` in 100 of those have the suffix first; which ones,
    and where, follows from the seed and the id alone, so copies of a row come out equal, and rows that
    share an id share their draws.

    A null text is an empty one. Empty texts, and those that hold a sentinel, stay plain, with null
    ``prefix_chars`` and ``middle_chars``. Texts are cut whole, however long. A null id counts as an empty
    one. Other columns stay as they are, one named ``fim`` is replaced. An empty table gives no rows.
    """
    given = [c for c in docs.columns if c not in ("fim", text_col)]
    inner = [f"c{i}" for i in range(len(given))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(given, inner)],
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
        *[h.alias(f"_h{k}_{i}") for k, seed in enumerate(seeds) for i, h in enumerate(_draws(id_col, seed))],
    )
    made = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in inner)
    made += "_seed bigint, _n bigint, _form string, _prefix bigint, _middle bigint, _out binary"
    formed = rows.mapInArrow(_formed(seeds, fim_rate, spm_rate, inner), made)
    fim = F.struct(
        F.col("_seed").alias("seed"),
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix").alias("prefix_chars"),
        F.col("_middle").alias("middle_chars"),
        F.col("_out").cast("string").alias("text"),
    )
    return formed.select(*[F.col(i).alias(c) for c, i in zip(given, inner)], fim.alias("fim"))


def restored(form: Column, output: Column) -> Column:
    """The text that was put into this form."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
