"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A store knows in how many documents every line occurs. Its exact side is a table
of line keys and counts, kept as signed generations: documents are inserted by a
generation of positive counts and deleted by one of negative counts. Its quick
side is one cuckoo filter per shard of the key space, which holds the lines that
occur in enough documents. A line whose count crosses the threshold, up or down,
enters or leaves its filter, so deleting documents undoes their insertion.

Lines are dropped in one pass over the texts, without a join: the filters are sent
to all tasks, and with them the few rare lines that they take for frequent ones,
which the exact counts name. Filters above a bound of bytes are not sent; then the
lines meet the counts in a join, and only keys travel.

A key is 128 bits of hash; two of 10**12 lines share one with a chance of about
one in 10**15.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.llm.textvec import give_back, mix
from semcat.plans.lineage import side_hint, sized, stored

SPACE = b" \t\n\x0b\x0c\r"
# places of a bucket, and the share of all places that a new filter fills at most
PLACES = 4
LOAD = 0.84
# rounds of moving fingerprints about before a filter counts as full
ROUNDS = 400
# keys of a shard that one task can hold
SHARD_KEYS = 1 << 18
# bytes of all filters, and rare lines taken for frequent ones, that are sent to every task
FILTER_BYTES = 64 << 20
EXCEPTIONS = 1 << 21
# counts that a task gathers before it passes them on
GATHERED = 200_000
# bytes of text whose lines are looked up together
SLICE_BYTES = 1 << 20
# generations of counts that are read together before they are added up
GENERATIONS = 8

KEY = "hi bigint, lo bigint"
FILTERS = "shard bigint, slots binary"


# ------------------------------------------------------------------ the filter


def _fingerprints(lo: np.ndarray, mask: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A key's fingerprint (never 0) and its first bucket; ``mask`` is the number of buckets less one."""
    low = lo.astype(np.uint64)
    mark = np.maximum(low & np.uint64(0xFFFF), np.uint64(1))
    return mark, (low >> np.uint64(16)) & np.asarray(mask, np.uint64)


def _other(bucket: np.ndarray, mark: np.ndarray, mask: np.ndarray | int) -> np.ndarray:
    """The other bucket of a fingerprint; known from either one alone."""
    return bucket ^ (mix(mark.astype(np.uint64)) & np.asarray(mask, np.uint64))


def _ranks(values: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate((np.ones(1, bool), ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values)) - first
    return ranks


def empty_slots(n_keys: int) -> np.ndarray:
    """Room for ``n_keys`` fingerprints; the number of buckets is a power of two."""
    buckets = 1
    while buckets * PLACES * LOAD < n_keys:
        buckets *= 2
    return np.zeros((buckets, PLACES), np.uint16)


def add(slots: np.ndarray, lo: np.ndarray) -> bool:
    """Put the keys' fingerprints into ``slots``; false if they do not all fit."""
    if not len(lo):
        return True
    mask = len(slots) - 1
    chance = np.random.default_rng(len(slots))
    mark, bucket = _fingerprints(lo, mask)
    for turn in range(ROUNDS):
        rank = _ranks(bucket)
        free = slots[bucket.astype(np.int64)] == 0
        room = free.sum(axis=1)
        fits = rank < room
        place = np.argsort(~free, axis=1, kind="stable")[np.arange(len(rank)), np.minimum(rank, PLACES - 1)]
        slots[bucket[fits].astype(np.int64), place[fits]] = mark[fits]
        mark, bucket, rank, room = mark[~fits], bucket[~fits], rank[~fits], room[~fits]
        if not len(mark):
            return True
        if turn:
            # one of each full bucket takes the place of another, which goes on instead
            pushes = rank == room
            at = bucket[pushes].astype(np.int64)
            victim = chance.integers(0, PLACES, len(at))
            out = slots[at, victim].astype(np.uint64)
            slots[at, victim] = mark[pushes]
            mark[pushes] = out
        bucket = _other(bucket, mark, mask)
    return False


def remove(slots: np.ndarray, lo: np.ndarray) -> int:
    """Take one copy of each key's fingerprint out of ``slots``; returns how many were not there."""
    mask = len(slots) - 1
    mark, bucket = _fingerprints(lo, mask)
    bucket = np.minimum(bucket, _other(bucket, mark, mask))
    absent = 0
    while len(mark):
        now = _ranks((bucket << np.uint64(16)) | mark) == 0
        here = bucket[now].astype(np.int64)
        there = _other(bucket[now], mark[now], mask).astype(np.int64)
        in_here = slots[here] == mark[now][:, None]
        at = np.where(in_here.any(axis=1), here, there)
        same = slots[at] == mark[now][:, None]
        found = same.any(axis=1)
        slots[at[found], same.argmax(axis=1)[found]] = 0
        absent += int((~found).sum())
        mark, bucket = mark[~now], bucket[~now]
    return absent


def build(lo: np.ndarray) -> np.ndarray:
    """A filter of these keys."""
    slots = empty_slots(len(lo))
    while not add(slots, lo):
        slots = np.zeros((2 * len(slots), PLACES), np.uint16)
    return slots


@dataclass
class Filters:
    """All shards' filters, one behind the other."""

    slots: np.ndarray  # bucket by place
    base: np.ndarray  # first bucket of a shard
    mask: np.ndarray  # number of a shard's buckets less one

    @staticmethod
    def of(rows: list[tuple[int, bytes]], n_shards: int) -> Filters:
        """``rows`` are (shard, slots); a shard without a row is empty."""
        parts = [empty_slots(0)] * n_shards
        for shard, slots in rows:
            parts[shard] = np.frombuffer(slots, np.uint16).reshape(-1, PLACES)
        sizes = np.array([len(p) for p in parts], np.int64)
        return Filters(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes - 1)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether a key may be held; a key that is held always gets true."""
        shard = hi & (len(self.base) - 1)
        mask, base = self.mask[shard], self.base[shard]
        mark, bucket = _fingerprints(lo, mask)
        wanted = mark.astype(np.uint16)[:, None]
        first = self.slots[base + bucket.astype(np.int64)] == wanted
        other = self.slots[base + _other(bucket, mark, mask).astype(np.int64)] == wanted
        return first.any(axis=1) | other.any(axis=1)


# ------------------------------------------------------------------------ keys


def _long_enough(key: bytes, min_chars: int) -> bool:
    return bool(key) if min_chars == 1 else len(key.decode("utf-8", "replace")) >= min_chars


def _as_numbers(digests: list[bytes]) -> np.ndarray:
    """Digests as (hi, lo)."""
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def _line_counts(sign: int, min_chars: int) -> Callable:
    """In how many texts of a task each line occurs, added up as far as memory allows."""

    def batch_of(counts: dict[bytes, int]) -> pa.RecordBatch:
        keys = _as_numbers(list(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts)) * sign
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], names=["hi", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for key in {line.strip(SPACE) for line in (text.as_py() or b"").lower().split(b"\n")}:
                    if _long_enough(key, min_chars):
                        digest = xxhash.xxh3_128_digest(key)
                        counts[digest] = counts.get(digest, 0) + 1
                        if len(counts) >= GATHERED:
                            yield batch_of(counts)
                            counts = {}
        if counts:
            yield batch_of(counts)
        give_back()

    return run


# ----------------------------------------------------------------------- store


@dataclass(frozen=True)
class LineStore:
    """What is known of the inserted documents' lines; every change makes a new store."""

    min_docs: int
    min_chars: int
    n_shards: int
    generations: tuple[DataFrame, ...]  # (hi, lo, n): counts to add up
    filters: DataFrame  # (shard, slots)

    def counts(self) -> DataFrame:
        """(hi, lo, n): in how many documents each line occurs."""
        return _added_up(self.generations)

    def frequent(self) -> DataFrame:
        """(hi, lo) of the lines that occur in enough documents."""
        return self.counts().filter(F.col("n") >= self.min_docs).select("hi", "lo")


def _added_up(generations: tuple[DataFrame, ...]) -> DataFrame:
    if len(generations) == 1:
        return generations[0]
    every = reduce(DataFrame.unionByName, generations)
    return every.groupBy("hi", "lo").agg(F.sum("n").alias("n")).filter("n <> 0")


def empty(spark: SparkSession, min_docs: int = 10, min_chars: int = 1) -> LineStore:
    """A store without documents, for lines of at least ``min_chars`` code points in ``min_docs`` documents."""
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars are at least 1")
    none = spark.createDataFrame([], f"{KEY}, n bigint")
    return LineStore(min_docs, min_chars, 1, (none,), spark.createDataFrame([], FILTERS))


def _shard(n_shards: int):
    return F.col("hi").bitwiseAND(F.lit(n_shards - 1)).alias("shard")


def _built(keys: DataFrame, n_shards: int) -> DataFrame:
    """The filters of all shards that have a key."""

    def make(part: pa.Table) -> pa.Table:
        slots = build(part.column("lo").to_numpy())
        return pa.table({"shard": part.column("shard")[:1], "slots": pa.array([slots.tobytes()], pa.binary())})

    return keys.select("lo", _shard(n_shards)).groupBy("shard").applyInArrow(make, FILTERS)


def _changed(filters: DataFrame, crossed: DataFrame, n_shards: int) -> DataFrame:
    """The filters after keys that crossed the threshold went in or out; null slots where they are full."""

    def make(old: pa.Table, new: pa.Table) -> pa.Table:
        lo, up = new.column("lo").to_numpy(), new.column("up").to_numpy(zero_copy_only=False)
        shard = (new if new.num_rows else old).column("shard")[:1]
        if not old.num_rows:
            slots, fits = build(lo[up]), True
        else:
            slots = np.frombuffer(old.column("slots")[0].as_py(), np.uint16).reshape(-1, PLACES).copy()
            fits = not remove(slots, lo[~up]) and add(slots, lo[up])
        return pa.table({"shard": shard, "slots": pa.array([slots.tobytes() if fits else None], pa.binary())})

    keys = crossed.select("lo", "up", _shard(n_shards))
    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(make, FILTERS)


def _changed_by(store: LineStore, docs: DataFrame, text_col: str, sign: int) -> LineStore:
    texts = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    found = texts.mapInArrow(_line_counts(sign, store.min_chars), f"{KEY}, n bigint")
    delta = stored(found.groupBy("hi", "lo").agg(F.sum("n").alias("n")))
    old = store.counts().withColumnRenamed("n", "old")
    met = delta.join(old.join(delta.select("hi", "lo").hint(side_hint(delta)), ["hi", "lo"], "left_semi"), ["hi", "lo"], "left")
    met = met.select("hi", "lo", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("n")).alias("new"))
    wanted = F.lit(store.min_docs)
    crossed = stored(
        met.filter((F.col("new") < 0) | ((F.col("old") < wanted) != (F.col("new") < wanted))).select(
            "hi", "lo", (F.col("new") >= wanted).alias("up"), (F.col("new") < 0).alias("below")
        )
    )
    up, below = crossed.agg(
        F.coalesce(F.sum(F.col("up").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("below").cast("int")), F.lit(0))
    ).first()
    if below:
        raise ValueError(f"{below} lines of the documents to delete were not inserted as often")
    generations = (*store.generations, delta) if store.filters.head(1) or len(store.generations) > 1 else (delta,)
    if len(generations) > GENERATIONS:
        generations = (stored(_added_up(generations)),)
    changed = replace(store, generations=generations)
    held = store.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0] // 2
    n_shards = store.n_shards
    while (held + up) > n_shards * SHARD_KEYS:
        n_shards *= 2
    if n_shards != store.n_shards:
        return replace(changed, n_shards=n_shards, filters=stored(_built(changed.frequent(), n_shards)))
    filters = stored(_changed(store.filters, crossed, n_shards))
    full = filters.filter("slots is null").select("shard")
    if full.head(1):
        # made anew, larger, from the exact counts
        keys = changed.frequent().withColumn("shard", _shard(n_shards)).join(F.broadcast(full), "shard", "left_semi")
        filters = stored(filters.filter("slots is not null").unionByName(_built(keys, n_shards)))
    return replace(changed, filters=filters)


def insert(store: LineStore, docs: DataFrame, text_col: str = "text") -> LineStore:
    """The store with these documents as well. Every row is a document, those that repeat an id or a text included."""
    return _changed_by(store, docs, text_col, 1)


def delete(store: LineStore, docs: DataFrame, text_col: str = "text") -> LineStore:
    """The store without these documents, as if they had never been inserted.

    Lines that were not inserted as often are an error, and nothing is changed.
    """
    return _changed_by(store, docs, text_col, -1)


def save(store: LineStore, folder: str) -> None:
    """Write a store to a folder of its own; what makes it readable is written last."""
    store.counts().write.parquet(f"{folder}/counts")
    store.filters.write.parquet(f"{folder}/filters")
    spark = store.filters.sparkSession
    meta = [(store.min_docs, store.min_chars, store.n_shards)]
    spark.createDataFrame(meta, "min_docs int, min_chars int, n_shards int").coalesce(1).write.parquet(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> LineStore:
    """A store that :func:`save` wrote."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    counts, filters = spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/filters")
    return LineStore(meta.min_docs, meta.min_chars, meta.n_shards, (counts,), filters)


# ----------------------------------------------------------------- dropping lines


def _kept(names: list[str], min_chars: int, frequent: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Texts without their frequent lines; ``frequent`` judges (rows, keys), the rows as places in the batch."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
        first, size, held = 0, 0, []
        for i, value in enumerate(batch.column("_text")):
            text = value.as_py() or b""
            held.append(text.split(b"\n"))
            size += len(text)
            if size >= SLICE_BYTES:
                yield first, held
                first, size, held = i + 1, 0, []
        if held:
            yield first, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in rows_of(batch):
                digests, owner, place = [], [], []
                for i, lines in enumerate(texts):
                    for j, line in enumerate(lines):
                        key = line.strip(SPACE).lower()
                        if _long_enough(key, min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            owner.append(i)
                            place.append(j)
                dropped: list[set[int]] = [set() for _ in texts]
                if digests:
                    gone = frequent(batch, first + np.array(owner), _as_numbers(digests))
                    for k in np.flatnonzero(gone).tolist():
                        dropped[owner[k]].add(place[k])
                out = [
                    b"\n".join([x for j, x in enumerate(lines) if j not in gone]) if gone else b"\n".join(lines)
                    for lines, gone in zip(texts, dropped)
                ]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array(out, pa.binary()), pa.array([len(x) for x in texts], pa.int64())]
                    + [pa.array([len(x) for x in dropped], pa.int64())],
                    names=names + ["_kept", "_n_lines", "_n_dropped"],
                )
        give_back()

    return run


def _sorted_keys(keys: np.ndarray) -> np.ndarray:
    return np.sort(np.ascontiguousarray(keys.astype(np.int64)).view([("hi", np.int64), ("lo", np.int64)]).ravel())


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    wanted = np.ascontiguousarray(keys).view(known.dtype).ravel()
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def _probe(shared) -> Callable:
    """The keys of a batch that the filters take for frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = shared.value.has(batch.column("hi").to_numpy(), batch.column("lo").to_numpy())
            yield batch.filter(pa.array(held))

    return run


def _text_keys(min_chars: int) -> Callable:
    """(text's key, line's key) of every line of a batch, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("_text")):
                keys = {x.strip(SPACE).lower() for x in (text.as_py() or b"").split(b"\n")}
                digests = _as_numbers([xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, min_chars)])
                if len(digests):
                    own = [pa.array([batch.column(c)[i].as_py()] * len(digests), pa.int64()) for c in ("_t1", "_t2")]
                    yield pa.RecordBatch.from_arrays(
                        own + [pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["_t1", "_t2", "hi", "lo"]
                    )

    return run


def keep(
    store: LineStore,
    docs: DataFrame,
    text_col: str = "text",
    known: bool = False,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``line_dedup`` of ``text``, ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n``. A line's key is the line without white space at its ends and with A-Z lowered;
    lines whose key occurs in at least ``min_docs`` inserted documents go, in every document, and the
    others are joined again. ``known`` says that all of ``docs`` were inserted, which saves a look at
    their lines.

    A null or empty text is one empty line, which stays. A text that loses all lines is empty. Long
    texts are read whole. Rows that repeat an id or a text are documents like any others, and so are
    those with a null id: ids are not looked at. Other columns stay as they are, one named ``line_dedup``
    is replaced. An empty table gives no rows.
    """
    given = [c for c in docs.columns if c != "line_dedup"]
    inner = [f"c{i}" for i in range(len(given))]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(given, inner)], text.cast("binary").alias("_text"))
    made = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"])
    made += ", _kept binary, _n_lines bigint, _n_dropped bigint"
    bytes_of_all = store.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0]
    context, exceptions = docs.sparkSession.sparkContext, None
    if bytes_of_all <= filter_bytes:
        filters = Filters.of([tuple(r) for r in store.filters.collect()], store.n_shards)
        shared = context.broadcast(filters)
        if known:
            asked = store.counts().filter(F.col("n") < store.min_docs).select("hi", "lo")
            exceptions = stored(asked.mapInArrow(_probe(shared), KEY))
        else:
            lines = rows.select(F.lit(0).cast("bigint").alias("_t1"), F.lit(0).cast("bigint").alias("_t2"), "_text")
            asked = lines.mapInArrow(_text_keys(store.min_chars), f"_t1 bigint, _t2 bigint, {KEY}")
            maybe = asked.select("hi", "lo").mapInArrow(_probe(shared), KEY).distinct()
            exceptions = stored(maybe.join(store.frequent(), ["hi", "lo"], "left_anti"))
        if exceptions.count() > EXCEPTIONS:
            exceptions = None
    if exceptions is not None:
        rare = context.broadcast(_sorted_keys(np.array(exceptions.collect(), np.int64).reshape(-1, 2)))

        def by_filter(batch: pa.RecordBatch, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
            maybe = shared.value.has(keys[:, 0], keys[:, 1])
            maybe[maybe] = ~_among(keys[maybe], rare.value)
            return maybe

        kept = rows.mapInArrow(_kept(inner, store.min_chars, by_filter), made)
    else:
        # equal texts lose equal lines, so a text's key stands for its rows
        keyed = rows.withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})
        lines = keyed.select("_t1", "_t2", "_text").mapInArrow(
            _text_keys(store.min_chars), f"_t1 bigint, _t2 bigint, {KEY}"
        )
        hits = lines.join(sized(store.frequent()), ["hi", "lo"])
        own = stored(hits.groupBy("_t1", "_t2").agg(F.collect_set(F.struct("hi", "lo")).alias("_own")))
        met = keyed.join(own.hint(side_hint(own)), ["_t1", "_t2"], "left").drop("_t1", "_t2")

        def by_row(batch: pa.RecordBatch, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
            gone = np.zeros(len(keys), bool)
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), owner[1:] != owner[:-1])))
            for a, b in zip(first, np.append(first[1:], len(owner))):
                own = batch.column("_own")[int(owner[a])].as_py()
                if own:
                    gone[a:b] = _among(keys[a:b], _sorted_keys(np.array([(x["hi"], x["lo"]) for x in own], np.int64)))
            return gone

        kept = met.mapInArrow(_kept(inner, store.min_chars, by_row), made)
    found = F.struct(
        F.col("_kept").cast("string").alias("text"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped")
    )
    return kept.select(*[F.col(i).alias(c) for c, i in zip(given, inner)], found.alias("line_dedup"))
