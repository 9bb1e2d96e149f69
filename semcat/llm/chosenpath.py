"""Similarity join of texts on word shingles by chosen paths.

A text is the set of its five-word shingles. Sets are embedded as 64 minhash
tokens. Every run samples tokens (each with probability 1 / (threshold * 64), so
1.25 on average) and sends a set to one bucket per sampled token; buckets that
are still large are split again, by tokens sampled for that path, and small ones
are compared. Runs repeat until the chance of losing a pair at the threshold is
below ``1 - recall`` even at the greatest depth.

What is found this way only decides which texts are looked at together. Links
are then counted exactly, on whole shingle sets, inside each group: large groups
are cut into blocks and every pair of blocks is one task, so a group of any size
is spread, and no pair is ever emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm import textvec as tv
from semcat.llm.components import connected
from semcat.plans.lineage import stored

TOKENS = 64
DEPTH = 4
# a pair at the threshold agrees on this share of the tokens, but for a chance of 1e-4
SLACK = 0.2
# a bucket is compared if it has so few sets, or so few rows and pairs of different groups (counted twice)
BUCKET = 256
BUCKET_ROWS = 1 << 16
BUCKET_PAIRS = 1 << 21
# sets and shingles that one block of a group holds
BLOCK_SETS = 400
BLOCK_SHINGLES = 400_000
# bits of the filter that spares most texts the second shuffle; 16 MB at any size
FILTER_BITS = 27


def runs_needed(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def _sampled(run: int, path: int, threshold: float) -> np.ndarray:
    """Tokens that a path samples; the same wherever it is asked."""
    ids = np.arange(TOKENS, dtype=np.uint64)
    h = tv.mix(ids + np.uint64((path * 0x9E3779B97F4A7C15 + run * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
    return np.flatnonzero(h.astype(np.float64) / 2.0**64 < 1 / (threshold * TOKENS))


def _multipliers() -> list[tuple[np.uint64, np.uint64]]:
    h = tv.mix(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return list(zip(h[:TOKENS] | np.uint64(1), h[TOKENS:]))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, shingles, first, key) of slices; the key identifies a set."""
    for a, b, data, offsets in tv.slices(column):
        shingles, first = tv.distinct_per_text(
            *tv.shingle_hashes(tv.Words(data, offsets, tv.ALPHANUMERIC), k)
        )
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tv.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        key = tv.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
        yield a, b, shingles, first, key


def _features(k: int, plan: list[tuple[int, int]]):
    multipliers = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, first, key in _sets(batch.column("text"), k):
                n = np.diff(first)
                some = np.flatnonzero(n)
                least = np.zeros((len(n), TOKENS), np.uint64)
                if len(some):
                    for i, (x, y) in enumerate(multipliers):
                        least[some, i] = np.minimum.reduceat(shingles * x + y, first[some])
                mixed = tv.mix(least)
                paths = np.stack(
                    [tv.mix(mixed[:, i] ^ np.uint64((r * TOKENS + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for r, i in plan],
                    axis=1,
                )
                sketch = (mixed & np.uint64(0xFF)).astype(np.uint8)
                count = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(tv.signed(key), mask=n == 0),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(
                            np.arange(count + 1, dtype=np.int32) * len(plan), tv.signed(paths.ravel())
                        ),
                        _binary(sketch.tobytes(), np.arange(count + 1) * TOKENS),
                    ],
                    names=["doc_id", "key", "n", "paths", "sketch"],
                )

    return run


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)]
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _alike(least: float):
    """Of rows (a, b, sketch_a, sketch_b): the pairs whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sketch_a")) == _matrix(batch.column("sketch_b"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= least * TOKENS))

    return run


class _Groups:
    """Consecutive rows of equal key, over the batches of one sorted partition."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: list[str]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in self.keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            borders = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(borders, borders[1:]):
                key = tuple(c[a] for c in columns)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)


def _forest(n: int, left: np.ndarray, right: np.ndarray, root: list[int] | None = None) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees."""
    root = list(range(n)) if root is None else root

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(left.tolist(), right.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(least: float):
    """Edges between sets of a bucket that are alike and not yet in one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Groups(batches, ["path", "i", "j"]):
            key = table.column("key").to_numpy()
            label = table.column("label").to_numpy()
            block = table.column("block").to_numpy()
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            sketch = _matrix(table.column("sketch").combine_chunks())
            upper, lower = np.flatnonzero(block == i), np.flatnonzero(block == j)
            left, right = [], []
            for x in upper.tolist():
                other = lower[lower > x] if i == j else lower
                other = other[label[other] != label[x]]
                if len(other):
                    same = (sketch[other] == sketch[x]).sum(axis=1)
                    hit = other[same >= least * TOKENS]
                    left.append(np.full(len(hit), x))
                    right.append(hit)
            if left:
                # sets of one label are one group already
                _, start = np.unique(label, return_inverse=True)
                kept = _forest(len(key), start[np.concatenate(left)], start[np.concatenate(right)])
                labels = np.unique(label)
                if kept:
                    pairs = np.array(kept)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(labels[pairs[:, 0]]), pa.array(labels[pairs[:, 1]])], schema=_EDGE
                    )

    return run


def _split(threshold: float):
    """Rows of large buckets, once for each token that their path samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy()
            sketch = _matrix(batch.column("sketch"))
            for p in np.unique(path).tolist():
                rows = np.flatnonzero(path == p)
                if p not in sampled:
                    if len(sampled) > 100_000:
                        sampled.clear()
                    sampled[p] = _sampled(1, p % (1 << 64), threshold)
                for i in sampled[p].tolist():
                    with np.errstate(over="ignore"):
                        child = tv.mix(
                            np.uint64(p % (1 << 64)) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + tv.mix(sketch[rows, i].astype(np.uint64) + np.uint64(1))
                        )
                    part = batch.take(pa.array(rows))
                    yield part.set_column(
                        part.schema.get_field_index("path"), "path", pa.array(tv.signed(child))
                    )

    return run


def _by_path(rows: DataFrame) -> DataFrame:
    """Rows of buckets that may still join two groups, with the bucket's size and whether it is compared now.

    Only pairs of different groups are compared, so a bucket that one large group
    fills but for a few rows is little work.
    """
    groups = rows.groupBy("path", "label").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("path").agg(
        F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("_within"), F.count("*").alias("_groups")
    )
    pairs = F.col("size") * F.col("size") - F.col("_within")
    now = (F.col("size") <= BUCKET) | ((F.col("size") <= BUCKET_ROWS) & (pairs <= BUCKET_PAIRS))
    return rows.join(sizes.filter("_groups > 1").select("path", "size", now.alias("now")), "path")


def _blocked(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block belongs to; adds block, i, j."""
    rows = rows.withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    )
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumns(
        {"i": F.least("block", "_other").cast("int"), "j": F.greatest("block", "_other").cast("int")}
    ).drop("_other", "_blocks")


def _coarse_groups(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, label): sets that chosen paths bring together; other sets have no row."""
    least = threshold - SLACK
    found = sets.select(F.explode("paths").alias("path"), "key")
    buckets = stored(
        found.groupBy("path").agg(F.count("*").alias("size"), F.min("key").alias("lead")).filter("size > 1")
    )
    members = stored(found.join(buckets.select("path", "lead"), "path"))
    # first every set against the least of its buckets: large groups fall into place at once
    sketches = sets.select("key", "sketch")
    pairs = members.filter("lead <> key").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    first = stored(
        pairs.join(sketches.toDF("b", "sketch_b"), "b")
        .join(sketches.toDF("a", "sketch_a"), "a")
        .mapInArrow(_alike(least), "a bigint, b bigint")
    )
    labels = stored(connected(first))
    # then all others: within buckets that hold more than one group
    label = F.coalesce("label", "key").alias("label")
    rows = members.select("path", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    rows = _by_path(rows.select("path", "key", label)).select("path", "key", "label", "size", "now")
    rows = stored(rows.join(sketches, "key"))
    edges = first
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH
        small = rows if last else rows.filter("now")
        blocks = F.when(F.col("now"), 1).otherwise(F.ceil(F.col("size") / BUCKET_ROWS**0.5)).cast("int")
        near = (
            _blocked(small.select("path", "key", "label", "sketch", "size", "now"), blocks)
            .repartition("path", "i", "j")
            .sortWithinPartitions("path", "i", "j", "key")
            .mapInArrow(_compare(least), "a bigint, b bigint")
        )
        edges = edges.unionByName(near)
        large = rows.filter("not now")
        if last or large.isEmpty():
            break
        children = large.select("path", "key", "label", "sketch").mapInArrow(
            _split(threshold), "path bigint, key bigint, label bigint, sketch binary"
        )
        rows = stored(_by_path(children))
    return stored(connected(edges))


def _place(key: np.ndarray, id_hash: pa.Array) -> np.ndarray:
    """A row's bit in the filter of members."""
    ids = id_hash.to_numpy(zero_copy_only=False).view(np.uint64)
    return tv.mix(key.view(np.uint64) ^ tv.mix(ids)) >> np.uint64(64 - FILTER_BITS)


def _member_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = _place(batch.column("key").to_numpy(), batch.column("id_hash"))
        word = (place >> np.uint64(5)).astype(np.int32)
        bit = (np.uint64(1) << (place & np.uint64(31))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])


def _member_filter(members: DataFrame) -> np.ndarray:
    """A bit for each member: a table of fixed size, whatever their number."""
    words = members.select("key", "id_hash").mapInArrow(_member_bits, "word int, bits bigint")
    got = words.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return bits


def _sets_of_members(bits, k: int):
    """(id_hash, key, shingles) of the texts whose bit is set, made once more from their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        sent: set = set()
        for batch in batches:
            for a, b, shingles, first, key in _sets(batch.column("text"), k):
                ids = batch.column("id_hash").slice(a, b - a)
                place = _place(key, ids)
                keep = (table[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1
                keep[np.diff(first) == 0] = 0
                rows = np.flatnonzero(keep)
                # a row that a task has sent already; what other tasks send goes later
                pairs = list(zip(key[rows].tolist(), ids.take(pa.array(rows)).to_pylist()))
                rows = np.array([r for r, p in zip(rows.tolist(), pairs) if p not in sent], np.int64)
                if len(sent) < 200_000:
                    sent.update(pairs)
                if len(rows):
                    every = _binary(shingles.tobytes(), first * 8)
                    rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), pa.array(tv.signed(key)).take(rows), every.take(rows)],
                        names=["id_hash", "key", "shingles"],
                    )

    return run


def _count_links(threshold: float):
    """Exact links of every pair of blocks: (a, links) per set and the edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Groups(batches, ["label", "i", "j"]):
            key = table.column("key").to_numpy()
            _, once = np.unique(key, return_index=True)
            table = table.take(pa.array(once))
            key = key[once]
            copies = table.column("copies").to_numpy()
            block = table.column("block").to_numpy()
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").combine_chunks().to_pylist()]
            size = np.array([len(s) for s in sets])
            upper, lower = np.flatnonzero(block == i), np.flatnonzero(block == j)
            common = _intersections(sets, upper, lower)
            union = size[upper][:, None] + size[lower][None, :] - common
            # in whole numbers, so that exactly the threshold counts
            linked = common * 1_000_000 >= round(threshold * 1_000_000) * union
            if i == j:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(key), np.int64)
            links[upper] += linked @ copies[lower]
            if i != j:
                links[lower] += linked.T @ copies[upper]
            x, y = np.nonzero(linked)
            kept = np.array(_forest(len(key), upper[x], lower[y]), np.int64).reshape(-1, 2)
            some = np.flatnonzero(links)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(key[some]), pa.array(key[kept[:, 0]])]),
                    pa.concat_arrays([none, pa.array(key[kept[:, 1]])]),
                    pa.concat_arrays([pa.array(links[some]), pa.array(np.zeros(len(kept), np.int64))]),
                ],
                names=["a", "b", "links"],
            )

    return run


def _intersections(sets: list[np.ndarray], upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, in column chunks of an incidence matrix."""
    common = np.zeros((len(upper), len(lower)), np.int64)
    if len(upper) * len(lower) <= 16:
        for p, x in enumerate(upper):
            for q, y in enumerate(lower):
                common[p, q] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return common
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    column = np.cumsum(np.concatenate(([0], every[1:] != every[:-1])))
    width = 4096
    borders = np.searchsorted(column, np.arange(0, column[-1] + width, width))
    for at, (a, b) in enumerate(zip(borders, np.append(borders[1:], len(column)))):
        if a == b:
            continue
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - at * width] = 1
        common += (m[upper] @ m[lower].T).astype(np.int64)
    return common


def similarity_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
) -> DataFrame:
    """One row per row of ``docs``: its id as ``doc_id``, ``class_id``, ``n_links``, ``n_shingles``.

    Two rows are linked if the Jaccard similarity of their shingle sets is at
    least ``threshold``. ``n_links`` counts the other rows a row is linked to,
    copies included; ``class_id`` is the least id of all rows reached by links.
    Words are runs of letters, digits and characters beyond ASCII, with A-Z
    lower-cased. A text of fewer than ``k`` words has one shingle, all its words.

    Ids are of any type that has an order; they keep it. Rows without any word
    (null, empty or only signs) link to nothing: their class is their own id. Very
    long texts are compared whole. Repeated rows are copies of each other. A null id
    stays null and never names a class unless all ids of the class are null.
    Other columns are not looked at. An empty table gives no rows.
    """
    plan = [(r, int(i)) for r in range(runs_needed(recall)) for i in _sampled(0, r + 1, threshold)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    features = stored(
        texts.mapInArrow(
            _features(k, plan),
            f"doc_id {kind}, key bigint, n int, paths array<bigint>, sketch binary",
        )
    )
    sets = stored(
        features.filter("key is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("paths").alias("paths"),
            F.first("sketch").alias("sketch"),
        )
    )
    groups = _coarse_groups(sets, threshold)
    id_hash = F.xxhash64("doc_id").alias("id_hash")
    members = groups.withColumnRenamed("node", "key").join(sets.select("key", id_hash, "copies", "n"), "key")
    blocks = groups.join(sets.select(F.col("key").alias("node"), "n"), "node").groupBy("label").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = stored(members.join(blocks, "label"))
    bits = docs.sparkSession.sparkContext.broadcast(_member_filter(members))
    counted = stored(
        texts.select(id_hash, "text")
        .mapInArrow(_sets_of_members(bits, k), "id_hash bigint, key bigint, shingles binary")
        .join(
            members.select("label", "key", F.col("id_hash").alias("_id"), "copies", "blocks"),
            "key",
        )
        .filter("id_hash = _id")
        .transform(lambda d: _blocked(d.drop("_id", "id_hash"), F.col("blocks")))
        .select("label", "i", "j", "block", "key", "copies", "shingles")
        .repartition("label", "i", "j")
        .sortWithinPartitions("label", "i", "j")
        .mapInArrow(_count_links(threshold), "a bigint, b bigint, links bigint")
    )
    classes = connected(counted.filter("b is not null").select("a", "b"))
    links = counted.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    per_set = (
        sets.select("key", "doc_id", "copies")
        .join(classes.withColumnRenamed("node", "key"), "key", "left")
        .join(links, "key", "left")
        .select(
            "key",
            "doc_id",
            F.coalesce("label", "key").alias("label"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
        .filter("n_links > 0")
    )
    per_set = stored(per_set)
    named = per_set.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    per_set = per_set.join(named, "label").select("key", "class_id", "n_links")
    rows = features.select("doc_id", "key", "n")
    linked = rows.filter("key is not null").join(per_set, "key", "left")
    # rows without words meet nothing; one key of theirs would gather them in one task
    alone = rows.filter("key is null").withColumns(
        {"class_id": F.lit(None).cast(per_set.schema["class_id"].dataType), "n_links": F.lit(None).cast("bigint")}
    )
    return linked.unionByName(alone).select(
        "doc_id",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.col("n").cast("bigint").alias("n_shingles"),
    )
