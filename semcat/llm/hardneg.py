"""Hard negatives from blocks along a Hilbert curve, chosen by their zone maps.

Rows are ordered by label and then along a Hilbert curve through the dimensions of
greatest variance, and cut into blocks of neighbours. A block is one row of a
Parquet table; a narrow second table, the zone map, holds each block's least and
greatest value of every dimension. By interval arithmetic an anchor's scores with
all rows of a block lie between two bounds, worked out from the zone alone, so the
zone map says which blocks an anchor must read:

* for its positives, blocks of its label whose upper bound reaches the score of
  the last positive found in its most promising block;
* for the negatives of a positive, blocks of other labels whose bounds meet the
  window of allowed scores above the last negative found in its two most promising
  blocks.

Both are exact. Anchors come in batches of bounded size, which are sent to all
tasks; blocks stay where they are and are never shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.llm.textvec import give_back
from semcat.plans.lineage import shared_folder, side_hint, stored

# the curve: dimensions of greatest variance, and bits of each
CURVE_DIMS = 16
CURVE_BITS = 4
# rows of a block at most, and bytes of its vectors
BLOCK_ROWS = 512
BLOCK_BYTES = 4 << 20
# blocks of one folder of the block table, and bytes of vectors a task orders
PART_BLOCKS = 64
ORDERED_BYTES = 32 << 20
# anchors of a batch at most, and bytes of their vectors
ANCHORS = 1 << 15
ANCHOR_BYTES = 16 << 20
# the greatest sum of squares of a row: products of two rows, times 100, then fit into a long
LARGEST = float(1 << 55)
# promising blocks that give the first bound
SEEDS_SAME, SEEDS_OTHER = 1, 2
# findings a task holds before it drops those that are too low, and scores looked at at once
HELD = 200_000
SCORES = 1 << 20
# folders that a filter names, at most
NAMED_PARTS = 4096

_NONE = -(1 << 62)
FOUND = "slot bigint, score bigint, id bigint"


# ------------------------------------------------------------------ the blocks


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of ``cells`` (row by dimension, each below 2**bits)."""
    x = cells.T.astype(np.uint64)
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a slice, all of ``dim`` components."""
    return column.flatten().to_numpy().reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each number of components that a batch holds."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield rows, _matrix(batch.column("q").take(pa.array(rows)), dim)


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per component of a task's vectors: how often it occurs, its sums and its range."""
    seen = np.zeros((0, 5))
    for batch in batches:
        for _, q in _by_dim(batch):
            dim = q.shape[1]
            if dim > len(seen):
                more = np.tile([0.0, 0.0, 0.0, np.inf, -np.inf], (dim - len(seen), 1))
                seen = np.concatenate((seen, more))
            x = q.astype(np.float64)
            seen[:dim, 0] += len(x)
            seen[:dim, 1] += x.sum(axis=0)
            seen[:dim, 2] += (x * x).sum(axis=0)
            seen[:dim, 3] = np.minimum(seen[:dim, 3], x.min(axis=0))
            seen[:dim, 4] = np.maximum(seen[:dim, 4], x.max(axis=0))
    if len(seen):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(seen)))] + [pa.array(seen[:, i].copy()) for i in range(5)],
            names=["pos", "n", "s", "ss", "lo", "hi"],
        )


def _curve(axes: list[tuple[int, float, float]]) -> Callable:
    """Adds each row's place along the curve through ``axes`` (component, least, greatest value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.zeros(batch.num_rows, np.uint64)
            for rows, q in _by_dim(batch):
                cells = np.zeros((len(rows), max(len(axes), 1)), np.uint64)
                for i, (pos, lo, hi) in enumerate(axes):
                    if pos < q.shape[1] and hi > lo:
                        share = (q[:, pos] - lo) / (hi - lo)
                        cells[:, i] = np.minimum(share * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1).astype(np.uint64)
                place[rows] = hilbert(cells, CURVE_BITS)
            # signed, in the same order
            key = (place ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "place"])

    return run


BLOCKS = "part bigint, block bigint, label string, dim int, lo array<int>, hi array<int>, largest double, ids binary, vectors binary"


def _blocks(block_rows: int) -> Callable:
    """Ordered rows as blocks, each of one label and one number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kind: tuple[str, int] | None = None

        def block() -> pa.RecordBatch:
            nonlocal number, held
            ids, q = (np.concatenate(x) for x in zip(*held))
            row = {
                "part": number // PART_BLOCKS,
                "block": number,
                "label": kind[0],
                "dim": kind[1],
                "lo": q.min(axis=0).tolist(),
                "hi": q.max(axis=0).tolist(),
                "largest": float((q.astype(np.float64) ** 2).sum(axis=1).max()),
                "ids": ids.astype("<i8").tobytes(),
                "vectors": q.astype("<i4").tobytes(),
            }
            number, held = number + 1, []
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            kinds += [pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            ids = batch.column("id").to_numpy()
            row = 0
            while row < batch.num_rows:
                own = (labels[row], dims[row])
                if held and own != kind:
                    yield block()
                kind = own
                room = max(1, min(block_rows, BLOCK_BYTES // (4 * max(own[1], 1)))) - sum(len(x) for x, _ in held)
                end = row
                while end < batch.num_rows and end - row < room and (labels[end], dims[end]) == own:
                    end += 1
                q = batch.column("q").slice(row, end - row)
                held.append((ids[row:end], _matrix(q, own[1])))
                if end - row == room:
                    yield block()
                row = end
        if held:
            yield block()

    return run


@dataclass(frozen=True)
class Blocks:
    blocks: DataFrame
    zones: DataFrame  # all but ids and vectors


def _rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, scale: int) -> DataFrame:
    """The rows that take part: whole numbers, labels as strings."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    # null for a null component, too great for infinities and NaN
    squares = F.aggregate(vector, F.lit(0.0), lambda got, x: got + (F.lit(float(scale)) * x) * (F.lit(float(scale)) * x))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("int"))
    return rows.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & (squares <= LARGEST)).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.size(vector).alias("dim"),
        whole.alias("q"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )


def build(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Blocks:
    """The block table and its zone map; ``rows`` has ``id, label, dim, q, place``."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.lit(4).cast("bigint") * F.col("dim") + 8)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // ORDERED_BYTES))
    keys = ["dim", "label", "place", "id"]
    ordered = rows.repartitionByRange(int(tasks), *keys).sortWithinPartitions(*keys)
    folder = shared_folder(spark)
    made = ordered.select("id", "label", "dim", "q").mapInArrow(_blocks(block_rows), BLOCKS)
    made.write.partitionBy("part").parquet(folder)
    blocks = spark.read.schema(made.schema).parquet(folder)
    return Blocks(blocks, stored(blocks.drop("ids", "vectors")))


# ----------------------------------------------------------------- the searches


@dataclass
class Anchors:
    """A batch of anchors, and how low a score may be to matter for each of its windows."""

    ids: np.ndarray
    labels: np.ndarray  # numbers of labels
    numbers: dict[str, int]
    rows: dict[int, np.ndarray]  # number of components to its anchors
    vectors: dict[int, np.ndarray]
    same: bool  # whether anchors look for rows of their own label
    floor: np.ndarray  # anchor by window
    ceiling: np.ndarray

    def wanted(self, zones: list[tuple[str, int, np.ndarray, np.ndarray]], best: bool = False) -> list:
        """For each zone: the anchors that must read its block, and if ``best``, how promising it is for them."""
        out = []
        for label, dim, lo, hi in zones:
            rows = self.rows.get(dim, np.zeros(0, np.int64))
            rows = rows[(self.labels[rows] == self.numbers.get(label, -1)) == self.same]
            if not len(rows):
                out.append((rows, np.zeros(0)) if best else rows)
                continue
            low, high = lo.astype(np.float64), hi.astype(np.float64)
            at = np.searchsorted(self.rows[dim], rows)
            up, down = self.up[dim][at], self.down[dim][at]
            upper, lower = up @ high + down @ low, up @ low + down @ high
            # beyond 2**53 sums of products are rounded
            slack = self.reach[dim] * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * 2.0**-50
            slack = 0.0 if slack < 8 else slack
            floor, ceiling = self.floor[rows], self.ceiling[rows]
            fits = (upper[:, None] + slack >= floor) & (lower[:, None] - slack <= ceiling) & (floor <= ceiling)
            fits = fits.any(axis=1)
            if best and not self.same:
                # what lies about the top of the windows, as higher scores are not allowed
                top = np.where(floor <= ceiling, ceiling, _NONE).max(axis=1)
                upper = -np.abs(top - (upper + lower) / 2)
            out.append((rows[fits], upper[fits]) if best else rows[fits])
        return out

    def prepared(self) -> Anchors:
        self.up = {d: np.maximum(v, 0).astype(np.float64) for d, v in self.vectors.items()}
        self.down = {d: np.minimum(v, 0).astype(np.float64) for d, v in self.vectors.items()}
        self.reach = {d: float(np.abs(v.astype(np.float64)).sum(axis=1).max(initial=0)) for d, v in self.vectors.items()}
        self.largest = {d: float((v.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for d, v in self.vectors.items()}
        return self


def _zones(batch: pa.RecordBatch) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    lo, hi = batch.column("lo"), batch.column("hi")
    return [
        (label, dim, lo[i].values.to_numpy(), hi[i].values.to_numpy())
        for i, (label, dim) in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
    ]


def _needed(shared) -> Callable:
    """The blocks that some anchor must read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value.prepared()
        for batch in batches:
            use = [len(rows) > 0 for rows in anchors.wanted(_zones(batch))]
            yield batch.select(["part", "block"]).filter(pa.array(use, pa.bool_()))

    return run


def _promising(shared, k: int) -> Callable:
    """Of a task's blocks, the ``k`` most promising ones for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value.prepared()
        top = np.full((len(anchors.ids), k), -np.inf)
        part, block = np.full(top.shape, -1, np.int64), np.full(top.shape, -1, np.int64)
        for batch in batches:
            names = zip(batch.column("part").to_pylist(), batch.column("block").to_pylist())
            for (p, b), (rows, promise) in zip(names, anchors.wanted(_zones(batch), best=True)):
                last = top[rows].argmin(axis=1)
                better = promise > top[rows, last]
                at = rows[better], last[better]
                top[at], part[at], block[at] = promise[better], p, b
        some = block.ravel() >= 0
        slot = np.repeat(np.arange(len(top)), k)[some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(part.ravel()[some]), pa.array(block.ravel()[some]), pa.array(top.ravel()[some])],
            names=["slot", "part", "block", "promise"],
        )

    return run


class _Best:
    """The ``k`` best findings of every slot: greatest score, then least id."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.held, self.size = k, floor.ravel().copy(), [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((slot, score, ids))
        self.size += len(slot)
        if self.size > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            none = np.zeros(0, np.int64)
            return none, none, none
        slot, score, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), slot[1:] != slot[:-1])))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        self.held = [(slot[keep], score[keep], ids[keep])]
        self.size = int(keep.sum())
        if self.size > HELD // 2:
            # what stays for good must not be sorted again at every step
            self.size = 0
        return self.held[0]


def _scores(x: np.ndarray, y: np.ndarray, product: float) -> np.ndarray:
    """Exact inner products; ``product`` bounds the product of the sums of squares of two rows."""
    if product <= float(1 << 48):
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64)
    if product <= float(1 << 106):
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def _read(shared, k: int, pairs=None) -> Callable:
    """Of a task's blocks, the best rows for every window of every anchor that must read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value.prepared()
        windows = anchors.floor.shape[1]
        best = _Best(k, anchors.floor)
        for batch in batches:
            largest = batch.column("largest").to_numpy()
            blocks = batch.column("block").to_pylist()
            for i, zone in enumerate(_zones(batch)):
                if pairs is not None:
                    rows = pairs.value.get(blocks[i], np.zeros(0, np.int64))
                else:
                    anchors.floor = best.floor.reshape(-1, windows)
                    rows = anchors.wanted([zone])[0]
                if not len(rows):
                    continue
                dim = zone[1]
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                q = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(len(ids), dim)
                at = np.searchsorted(anchors.rows[dim], rows)
                step = max(1, SCORES // len(ids))
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    score = _scores(anchors.vectors[dim][at[a : a + step]], q, largest[i] * anchors.largest[dim])
                    floor, ceiling = best.floor.reshape(-1, windows)[own], anchors.ceiling[own]
                    open_ = floor <= ceiling
                    low = np.where(open_, floor, -_NONE).min(axis=1)
                    high = np.where(open_, ceiling, _NONE).max(axis=1)
                    r, c = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
                    if anchors.same:
                        other = ids[c] != anchors.ids[own[r]]
                        r, c = r[other], c[other]
                    got = score[r, c]
                    fits = (got[:, None] >= floor[r]) & (got[:, None] <= ceiling[r])
                    hit, w = np.nonzero(fits)
                    best.add(own[r[hit]] * windows + w, got[hit], ids[c[hit]])
        slot, score, ids = best.cut()
        for a in range(0, len(slot), HELD):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[a : a + HELD].astype(np.int64)) for x in (slot, score, ids)], names=["slot", "score", "id"]
            )
        give_back()

    return run


def _top(found: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _chosen(table: Blocks, blocks: DataFrame) -> DataFrame:
    """The block table's rows that ``blocks``, a stored frame, names; whole folders are left out where few remain."""
    parts = [r.part for r in blocks.select("part").distinct().limit(NAMED_PARTS + 1).collect()]
    rows = table.blocks
    if len(parts) <= NAMED_PARTS:
        rows = rows.filter(F.col("part").isin(parts)) if parts else rows.filter("false")
    return rows.join(blocks.select("block").hint(side_hint(blocks)), "block", "left_semi")


def _search(table: Blocks, anchors: Anchors, k: int, seeds: int) -> DataFrame:
    """(slot, score, id, rank): the ``k`` best rows of every window of every anchor."""
    spark = table.blocks.sparkSession
    context = spark.sparkContext
    score = [F.col("score").desc(), F.col("id")]
    shared = context.broadcast(anchors)
    zones = table.zones
    guess = zones.mapInArrow(_promising(shared, seeds), "slot bigint, part bigint, block bigint, promise double")
    pairs = _top(guess, seeds, F.col("promise").desc(), F.col("block")).select("slot", "part", "block").toArrow()
    readers: dict[int, list[int]] = {}
    for slot, block in zip(pairs.column("slot").to_pylist(), pairs.column("block").to_pylist()):
        readers.setdefault(block, []).append(slot)
    if readers:
        sent = context.broadcast({b: np.array(sorted(rows), np.int64) for b, rows in readers.items()})
        named = stored(spark.createDataFrame(pairs.select(["part", "block"])).distinct())
        first = _chosen(table, named).mapInArrow(_read(shared, k, sent), FOUND)
        last = _top(first, k, *score).filter(F.col("rank") == k).select("slot", "score").toArrow()
        floor = anchors.floor.ravel()
        slots = last.column("slot").to_numpy()
        floor[slots] = np.maximum(floor[slots], last.column("score").to_numpy())
        shared = context.broadcast(anchors)
    needed = stored(zones.mapInArrow(_needed(shared), "part bigint, block bigint"))
    return _top(_chosen(table, needed).mapInArrow(_read(shared, k), FOUND), k, *score)


def _batch(rows: pa.Table, same: bool, floor: np.ndarray, ceiling: np.ndarray) -> Anchors:
    labels = rows.column("label").to_pylist()
    numbers = {label: i for i, label in enumerate(sorted(set(labels)))}
    dims = rows.column("dim").to_numpy()
    held = {d: np.flatnonzero(dims == d) for d in np.unique(dims).tolist()}
    q = rows.column("q").combine_chunks()
    vectors = {d: _matrix(q.take(pa.array(at)), d) for d, at in held.items()}
    codes = np.array([numbers[x] for x in labels], np.int64)
    return Anchors(rows.column("id").to_numpy(), codes, numbers, held, vectors, same, floor, ceiling)


RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    batch_anchors: int = ANCHORS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each row where ``anchor`` holds and each of its positives, its hardest allowed negatives.

    A component x counts as floor(scale * x); a row's score is its inner product with the anchor, greater
    ones come first, ties by least id. Positives are the first ``n_positives`` other rows of the anchor's
    label; negatives the first ``n_negatives`` rows of other labels with a score of ``low`` to ``high`` in
    100 of the positive's. One row each: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.

    Rows with a null id, label, vector or component, with a component that is not finite, or with a sum of
    squares above 2**55 (whose scores no long could hold) take no part. Ids are whole numbers. Rows that
    share an id all take part as candidates, but never as each other's positives, and each of them is an
    anchor if ``anchor`` holds. Vectors of other lengths than the anchor's are not compared with it. An
    anchor without positives or negatives gives no row, and so does an empty table. Other columns are not
    looked at.
    """
    spark = rows.sparkSession
    made = stored(_rows(rows, id_col, vector_col, label_col, anchor, scale))
    spread = made.select("dim", "q").mapInArrow(_spreads, "pos bigint, n double, s double, ss double, lo double, hi double")
    spread = spread.groupBy("pos").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    widest = spread.orderBy((F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).desc(), "pos").limit(CURVE_DIMS)
    axes = [(r.pos, r.lo, r.hi) for r in widest.collect()]
    placed = made.mapInArrow(_curve(axes), "id bigint, label string, dim int, q array<int>, is_anchor boolean, place bigint")
    table = build(placed, block_rows)
    anchors = placed.filter("is_anchor").select("id", "label", "dim", "q", "place")
    # near anchors read the same blocks, so a batch is a stretch of the curve
    size = anchors.agg(F.count("*").alias("n"), F.sum(F.lit(4).cast("bigint") * F.col("dim")).alias("b")).first()
    n_batches = max(1, -(-size.n // batch_anchors), -(-(size.b or 0) // ANCHOR_BYTES))
    borders = []
    if n_batches > 1:
        borders = sorted(set(anchors.approxQuantile("place", [i / n_batches for i in range(1, n_batches)], 0.2 / n_batches)))
    passed = F.filter(F.array(*[F.lit(x) for x in borders]).cast("array<double>"), lambda x: x <= F.col("place"))
    dealt = stored(anchors.withColumn("batch", F.size(passed)))
    sizes = {r.batch: -(-r["n"] // (2 * batch_anchors)) for r in dealt.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    folder = shared_folder(spark)
    spark.createDataFrame([], RESULT).write.parquet(f"{folder}/batch=none")
    for number, splits in sorted(sizes.items()):
        for split in range(splits):
            # a stretch that came out too long is dealt by id
            own = dealt.filter((F.col("batch") == number) & (F.pmod(F.xxhash64("id"), F.lit(splits)) == split))
            batch = own.select("id", "label", "dim", "q").orderBy("dim", "place", "id").toArrow()
            if batch.num_rows:
                found = _mined(table, batch, n_positives, n_negatives, low, high)
                found.write.parquet(f"{folder}/batch={number}-{split}")
    return spark.read.parquet(folder).drop("batch")


def _mined(table: Blocks, batch: pa.Table, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one batch of anchors."""
    n = batch.num_rows
    every = _batch(batch, True, np.full((n, 1), _NONE, np.int64), np.full((n, 1), -_NONE, np.int64))
    got = _search(table, every, n_positives, SEEDS_SAME).toArrow()  # n_positives rows an anchor
    slot, rank = got.column("slot").to_numpy(), got.column("rank").to_numpy() - 1
    positive = np.zeros((n, n_positives), np.int64)
    score = np.zeros((n, n_positives), np.int64)
    floor, ceiling = np.ones((n, n_positives), np.int64), np.zeros((n, n_positives), np.int64)
    positive[slot, rank] = got.column("id").to_numpy()
    score[slot, rank] = got.column("score").to_numpy()
    floor[slot, rank] = -((-low * score[slot, rank]) // 100)
    ceiling[slot, rank] = (high * score[slot, rank]) // 100
    # windows that nothing can fit, and anchors without so many positives, stay closed
    found = _search(table, _batch(batch, False, floor, ceiling), n_negatives, SEEDS_OTHER)
    named = table.blocks.sparkSession.sparkContext.broadcast((batch.column("id").to_numpy(), positive, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, positive, score = named.value
        for part in batches:
            slot = part.column("slot").to_numpy()
            a, w = slot // n_positives, slot % n_positives
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a]), pa.array(positive[a, w]), part.column("rank"), part.column("id")]
                + [pa.array(score[a, w]), part.column("score")],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return found.select("slot", "score", "id", F.col("rank").cast("int").alias("rank")).mapInArrow(run, RESULT)
