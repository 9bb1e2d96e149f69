"""Best-fit packing of token sequences by linear grouping.

Lengths are small whole numbers, so a corpus of any size is, for the packing, a
table of at most ``capacity`` counts. Large lengths are sorted, cut into groups
of equal cardinality and rounded up to the largest of their group. The few sizes
that remain are a cutting-stock problem over configurations (multisets of groups
that fit a sequence), solved by column generation. Its solution is filled with
the real lengths, and all others are placed best-fit, longest first. The result
is a list of runs: "the next so many pieces of this length go to these sequences
at this offset"; pieces find their place by their rank among equal lengths.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semcat.plans.lineage import stored

CAPACITY = 1024
END_ID = 2
GROUPS = 64
# lengths up to this share of a sequence are small: placed best-fit at the end
SMALL = 8
# a sequence filled by a configuration keeps at most this share of room
SPARE = 256
# pieces that one task ranks, about
RANKED_ROWS = 200_000


@functools.cache
def _encoder(path: str):
    """The byte-pair vocabulary at ``path`` (ranks, or a tokenizer file that has such beside it)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    """The ranks of the vocabulary ``byte_bpe_50k.json``: the same ids at a fifth of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pieces(vocabulary: str, capacity: int, end_id: int, keep_ids: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, ids_of = [], [], [], [], [], []
            for at, text in enumerate(batch.column("_text")):
                ids = encoder.encode_to_numpy(text.as_py() or "", disallowed_special=())
                ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                begin = 0
                end = len(ids) % capacity or capacity
                number = 0
                while begin < len(ids):
                    part = ids[begin:end]
                    row.append(at)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        ids_of.append(part.astype(np.int32))
                    begin, end, number = end, end + capacity, number + 1
            if not row:
                continue
            rows = pa.array(row, pa.int64())
            made = [
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if keep_ids:
                made.append(pa.array(ids_of, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in names] + made,
                names=names + ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids,
            )

    return run


@dataclass
class _Bins:
    """So many sequences of equal content: lengths in the order of their offsets, and the rest."""

    count: int
    lengths: list[int] = field(default_factory=list)
    gap: int = 0


def _groups(histogram: np.ndarray, smallest: int, n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, [(length, count), ...]) of groups of equal cardinality, longest first."""
    lengths = [x for x in range(len(histogram) - 1, smallest - 1, -1) if histogram[x]]
    total = int(sum(histogram[x] for x in lengths))
    if not total:
        return []
    each = -(-total // n_groups)
    groups, room = [], 0
    for length in lengths:
        left = int(histogram[length])
        while left:
            if not room:
                groups.append((length, []))
                room = each
            took = min(left, room)
            groups[-1][1].append((length, took))
            left, room = left - took, room - took
    # groups that were rounded up to one length are one size
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, content in groups:
        merged.setdefault(size, []).extend(content)
    return list(merged.items())


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth: an unbounded knapsack, one more piece at a time."""
    rest = np.arange(capacity + 1)[None, :] - sizes[:, None]
    closed = rest < 0
    np.maximum(rest, 0, out=rest)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value = best[rest] + worth[:, None]
        value[closed] = 0
        pick = value.argmax(axis=0)
        value = value[pick, np.arange(capacity + 1)]
        better = value > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best = np.maximum(value, best)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, times) by column generation, rounded down; what is left over is not covered."""
    m = len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // int(sizes[i])) for i in range(m)]
    basis = np.array(columns, float).T
    basic = list(range(m))
    inverse = np.linalg.inv(basis)
    for turn in range(1, rounds):
        amount = inverse @ demand
        worth = np.maximum(inverse.sum(axis=0), 0)
        value, counts = _best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ counts
        ratio = np.where(direction > 1e-9, np.maximum(amount, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        columns.append(counts)
        basic[leaves] = len(columns) - 1
        basis[:, leaves] = counts
        if turn % 50:
            row = inverse[leaves] / direction[leaves]
            inverse -= np.outer(direction, row)
            inverse[leaves] = row
        else:  # anew, against rounding errors
            inverse = np.linalg.inv(basis)
    amount = np.linalg.inv(basis) @ demand
    return [(columns[c], int(np.floor(x + 1e-6))) for c, x in zip(basic, amount) if x >= 1 - 1e-6]


def _substituted(
    sizes: np.ndarray, chosen: list[tuple[np.ndarray, int]], there: np.ndarray, capacity: int
) -> list[_Bins]:
    """The configurations, filled with real lengths, which are taken out of ``there``.

    A slot takes the longest piece that its rounded length stands for. The last
    slot of a sequence takes the longest piece that still fits, as the others
    were rounded up and left some room. A sequence that still has more than a small
    share of room, as a slot found nothing, is opened again: its pieces stay in ``there``.
    """
    bins: list[_Bins] = []
    opened, spare = np.zeros_like(there), capacity // SPARE
    below = np.append(sizes[1:], capacity // SMALL)  # sizes go down
    for counts, times in chosen:
        slots = [g for g in range(len(sizes)) for _ in range(int(counts[g]))]
        while times:
            lengths: list[int] = []
            room = capacity
            for at, g in enumerate(slots):
                last = at == len(slots) - 1
                top = min(room, capacity - 1) if last else int(sizes[g])
                bottom = capacity // SMALL if last else int(below[g])
                own = np.flatnonzero(there[bottom + 1 : top + 1])
                if len(own):
                    length = bottom + 1 + int(own[-1])
                    there[length] -= 1
                    lengths.append(length)
                    room -= length
            if not lengths:
                break
            # the same again, as often as all its lengths are there
            again = times - 1
            for length in set(lengths):
                again = min(again, int(there[length]) // lengths.count(length))
            for length in lengths:
                there[length] -= again
            times -= 1 + again
            if room <= spare:
                bins.append(_Bins(1 + again, lengths, room))
            else:
                for length in lengths:
                    opened[length] += 1 + again
    there += opened
    return bins


def _best_fit(bins: list[_Bins], rest: dict[int, int], capacity: int) -> list[_Bins]:
    """All other lengths, longest first, each into the sequences it fills best."""
    by_gap: list[list[_Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_gap[b.gap].append(b)
    for length in sorted(rest, reverse=True):
        left, gap = rest[length], length
        while left:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:
                by_gap[capacity].append(_Bins(-(-left // (capacity // length)), [], capacity))
                gap = capacity
            b = by_gap[gap].pop()
            each = gap // length
            full = min(b.count, left // each)
            if full < b.count:
                by_gap[gap].append(_Bins(b.count - full, list(b.lengths), gap))
            if full:
                got = _Bins(full, b.lengths + [length] * each, gap - each * length)
                by_gap[got.gap].append(got)
                left -= full * each
            elif left:
                # fewer are left than one sequence takes
                top = by_gap[gap].pop()
                if top.count > 1:
                    by_gap[gap].append(_Bins(top.count - 1, list(top.lengths), gap))
                got = _Bins(1, top.lengths + [length] * left, gap - left * length)
                by_gap[got.gap].append(got)
                left = 0
    return [b for same in by_gap for b in same if b.lengths]


def plan(histogram: np.ndarray, capacity: int = CAPACITY, n_groups: int = GROUPS) -> list[_Bins]:
    """Sequences for so many pieces of each length 1 ... ``capacity`` (index 0 is not used)."""
    rest = {x: int(histogram[x]) for x in range(1, capacity) if histogram[x]}
    groups = _groups(histogram[:capacity], capacity // SMALL + 1, n_groups)
    bins: list[_Bins] = []
    if groups:
        sizes = np.array([size for size, _ in groups])
        demand = np.array([sum(c for _, c in content) for _, content in groups], float)
        there = histogram[:capacity].copy()
        bins = _substituted(sizes, configurations(sizes, demand, capacity), there, capacity)
        rest = {x: int(there[x]) for x in rest if there[x]}
    bins = _best_fit(bins, rest, capacity)
    if histogram[capacity]:
        bins.append(_Bins(int(histogram[capacity]), [capacity], 0))
    return bins


def _runs(bins: list[_Bins]) -> dict[str, np.ndarray]:
    """For each length, in order: first rank, first sequence and offset of its runs."""
    rows: list[tuple[int, int, int, int]] = []
    ranks: dict[int, int] = {}
    sequence = 0
    for b in bins:
        offset = 0
        for length in b.lengths:
            rows.append((length, ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + b.count
            offset += length
        sequence += b.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _placed(runs, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for batch in batches:
            if batch.num_rows:
                rank = batch.column("_rank").to_numpy()
                at = np.searchsorted(table["key"], (batch.column("length").to_numpy() << 44) + rank, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names]
                    + [pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                    names=names + ["sequence_id", "offset"],
                )

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    n_groups: int = GROUPS,
) -> DataFrame:
    """All rows of ``docs``, as token ids and a final ``end_id``, in sequences of at most ``capacity``.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, with ``keep_ids``
    ``ids``, then ``sequence_id`` and ``offset``. Only documents longer than ``capacity`` are cut, so
    that all their pieces but the first are full. ``vocabulary`` is a file of byte-pair ranks.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed as any other row.
    Other columns are not looked at. An empty table gives no rows.
    """
    names = ["doc_id"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    made += ", ids array<int>" * keep_ids
    vocabulary = vocabulary or default_vocabulary()
    pieces = stored(rows.mapInArrow(_pieces(vocabulary, capacity, end_id, keep_ids, names), made))
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["n"]
    runs = docs.sparkSession.sparkContext.broadcast(_runs(plan(histogram, capacity, n_groups)))
    # ranks among equal lengths, in slices: one length may have any share of all pieces
    slices = int(histogram.sum()) // RANKED_ROWS + 1
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    before = (
        sliced.groupBy("length", "_slice")
        .agg(F.count("*").alias("n"))
        .withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("n"))
        .select("length", "_slice", "_before")
    )
    order = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("_rank", F.row_number().over(order) - 1)
        .join(before, ["length", "_slice"])
        .withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("bigint"))
    )
    columns = pieces.columns
    return ranked.select(*columns, "_rank").mapInArrow(
        _placed(runs, columns), f"{made}, sequence_id bigint, offset bigint"
    )
