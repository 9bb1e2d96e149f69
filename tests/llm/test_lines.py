"""Line dedup, fill-in-the-middle and hard negatives, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semcat.llm import hardneg, infilling, linedup

SPACE = " \t\n\x0b\x0c\r"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "é ü"), (4, "é ü"), (None, "null id"), (6, "word " * 30000 + "\n" + "x" * 300000)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------- line dedup


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def expected_lines(rows, known, min_docs, min_chars=1):
    """(id, lines, dropped, kept) of ``rows``, by the counts of the texts in ``known``."""
    counts = Counter(k for _, t in known for k in {key_of(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < min_chars or counts[key_of(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got_lines(df):
    rows = df.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "line_dedup.text").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def line_rows(seed, n, first=100):
    rng = random.Random(seed)
    pool = ["Menu", " menu\t", "MENU", "Ébène", "ébène", "", "  ", "\r", "a", "Footer © 2020", "日本", "x" * 5000] + [f"line {i}" for i in range(40)]
    return [(first + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(n)]


@pytest.mark.parametrize("filter_bytes", [linedup.FILTER_BYTES, 0])
@pytest.mark.parametrize("min_docs, min_chars", [(3, 1), (2, 5)])
def test_lines_are_dropped_as_counted(spark, docs, filter_bytes, min_docs, min_chars):
    rows = ODD + line_rows(1, 60)
    store = linedup.insert(linedup.empty(spark, min_docs, min_chars), docs(rows))
    want = expected_lines(rows, rows, min_docs, min_chars)
    assert got_lines(linedup.keep(store, docs(rows), known=True, filter_bytes=filter_bytes)) == want
    # texts that were not inserted are judged by the same counts
    others = line_rows(9, 30) + [(7, "never seen\nMenu"), (8, None)]
    found = linedup.keep(store, docs(others), filter_bytes=filter_bytes)
    assert got_lines(found) == expected_lines(others, rows, min_docs, min_chars)
    assert found.columns == [*docs([]).columns, "line_dedup"]


def test_deleting_undoes_inserting(spark, docs, tmp_path):
    a, b, c = ODD + line_rows(2, 40), line_rows(3, 50, 1000), line_rows(4, 40, 2000)
    once = linedup.insert(linedup.empty(spark, 4), docs(a))
    store = linedup.insert(linedup.insert(once, docs(b)), docs(c))
    assert got_lines(linedup.keep(store, docs(a))) == expected_lines(a, a + b + c, 4)
    store = linedup.delete(store, docs(b))
    assert got_lines(linedup.keep(store, docs(b))) == expected_lines(b, a + c, 4)
    linedup.save(store, f"{tmp_path}/store")
    store = linedup.delete(linedup.load(spark, f"{tmp_path}/store"), docs(c))
    assert sorted(map(tuple, store.counts().collect())) == sorted(map(tuple, once.counts().collect()))
    assert got_lines(linedup.keep(store, docs(c))) == expected_lines(c, a, 4)
    marks = lambda s: sorted(np.frombuffer(r.slots, np.uint16).tolist() for r in s.filters.collect())
    assert [sorted(x for x in m if x) for m in marks(store)] == [sorted(x for x in m if x) for m in marks(once)]
    with pytest.raises(ValueError, match="not inserted"):
        linedup.delete(store, docs([(1, "nobody has this line")]))
    gone = linedup.delete(store, docs(a))
    assert gone.counts().count() == 0 and gone.frequent().count() == 0


def test_many_generations_and_growing_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(linedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(linedup, "GENERATIONS", 3)
    store, known = linedup.empty(spark, 2), []
    for i in range(5):
        rows = line_rows(20 + i, 25, 100 * i)
        known += rows
        store = linedup.insert(store, docs(rows))
    assert store.n_shards > 1 and len(store.generations) <= 4
    assert got_lines(linedup.keep(store, docs(known), known=True)) == expected_lines(known, known, 2)


def test_no_documents_no_lines(spark, docs):
    store = linedup.insert(linedup.empty(spark), docs([]))
    assert linedup.keep(store, docs([])).count() == 0
    assert got_lines(linedup.keep(store, docs([(1, "a\nb")]))) == [(1, 2, 0, "a\nb")]
    with pytest.raises(ValueError):
        linedup.empty(spark, 0)


def test_filters_hold_what_was_added_and_lose_what_was_removed():
    rng = np.random.default_rng(7)
    keys = rng.integers(-(1 << 62), 1 << 62, (60000, 2))
    slots = linedup.build(keys[:, 1])
    held = linedup.Filters.of([(0, slots.tobytes())], 1)
    assert held.has(keys[:, 0], keys[:, 1]).all()
    others = rng.integers(-(1 << 62), 1 << 62, (200000, 2))
    assert held.has(others[:, 0], others[:, 1]).mean() < 0.0005
    slots = slots.copy()
    assert linedup.remove(slots, keys[:30000, 1]) == 0
    left = linedup.Filters.of([(0, slots.tobytes())], 1)
    assert left.has(keys[30000:, 0], keys[30000:, 1]).all()
    assert linedup.add(slots, keys[:30000, 1]) and linedup.remove(slots, keys[:, 1]) == 0
    assert not slots.any()
    assert linedup.remove(slots, keys[:3, 1]) == 3


def test_full_filters_are_noticed():
    slots = linedup.empty_slots(100)
    assert not linedup.add(slots, np.arange(100000, dtype=np.int64) << 16)


# -------------------------------------------------------- fill-in-the-middle


def expected_fim(i, text, seed=42, fim=50, spm=80):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return i, seed, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return i, seed, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_texts_are_cut_at_the_drawn_tokens_and_come_back(docs):
    rng = random.Random(3)
    words = ["the", "Ünïcode", "日本語", " ", "\n\n", "\t", " ", "<P>", "<S", ">", "M>", "x" * 700, "\x0b"]
    rows = ODD + [(10 + i, "".join(rng.choice(words[: 7 + i % 7]) + rng.choice([" ", ""]) for _ in range(rng.randrange(400)))) for i in range(150)]
    found = infilling.transform(docs(rows), seeds=(42, 7), fim_rate=70)
    assert found.columns == [c for c in docs([]).columns if c != "text"] + ["fim"]
    got = found.select("doc_id", "fim.*", infilling.restored(F.col("fim.form"), F.col("fim.text")).alias("back")).collect()
    want = [expected_fim(i, t, seed, 70) for seed in (42, 7) for i, t in rows]
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(want, key=repr)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert all(r.back in texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infilling.transform(docs([])).count() == 0


def test_every_rank_gives_its_exact_offset():
    rng = np.random.default_rng(5)
    shapes = [
        np.cumsum(rng.integers(0, 12, 50000)),
        np.cumsum(np.where(rng.random(20000) < 0.001, 100000, 3)),
        np.repeat(np.arange(300) * 1000, 40),
        np.array([0]),
        np.cumsum(np.full(30000, 7)),
        np.cumsum(rng.integers(0, 1 << 40, 500)),
        np.zeros(0, np.int64),
    ]
    for offsets in shapes:
        offsets = offsets.astype(np.int64)
        index = infilling.RankIndex.fit(offsets)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert len(index.residual) == len(offsets) and np.abs(index.residual.astype(int)).max(initial=0) <= infilling.ERROR + 1
    # a straight run of any length is one segment
    assert len(infilling.RankIndex.fit(np.cumsum(np.full(30000, 7))).first) == 1


# -------------------------------------------------------------- hard negatives


def expected_negatives(rows, every, n_positives=5, n_negatives=3, low=50, high=95, scale=256):
    use = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(scale * np.float32(x).astype(float)) for x in v], str(label)))
    use = [r for r in use if sum(x * x for x in r[1]) <= 1 << 55]
    out = []
    for i, v, label in use:
        if i % every:
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in use if len(w) == len(v)), key=lambda s: s[:2]
        )
        for minus, j, _ in [s for s in scored if s[2] == label and s[1] != i][:n_positives]:
            fits = [s for s in scored if s[2] != label and -low * minus <= -100 * s[0] <= -high * minus][:n_negatives]
            out += [(i, j, rank, s[1], -minus, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, place int, id string, q int"


def vectors(spark, rows):
    floats = lambda v: None if v is None else [None if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, floats(v), label, 1, "x", 2) for i, v, label in rows], VECTORS)


def vector_rows(seed, n, dim, centres=6, spread=0.15, tied=False):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(centres))
        v = middle[c] + spread * rng.normal(size=dim)
        v = np.round(v) if tied else v / np.linalg.norm(v)
        rows.append((i, v.astype(np.float32).tolist(), int(c if rng.random() < 0.6 else rng.integers(centres))))
    return rows


@pytest.mark.parametrize("dim, tied, block", [(8, False, 16), (3, True, 16), (40, False, 512)])
def test_negatives_are_the_hardest_allowed(spark, dim, tied, block):
    rows = vector_rows(dim, 700, dim, tied=tied)
    got = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, block_rows=block)
    assert sorted(map(tuple, got.collect())) == expected_negatives(rows, 10)


def test_rows_that_cannot_be_compared_take_no_part(spark):
    rows = vector_rows(4, 120, 5)
    bad = [1.0, float("nan"), 0.0, 0.0, 0.0]
    rows += [(500, bad, 1), (501, [math.inf] + [0.0] * 4, 1), (502, None, 1), (503, [0.1] * 5, None), (None, [0.1] * 5, 1)]
    rows += [(504, [None, 1.0, 0.0, 0.0, 0.0], 2), (505, [3e38] * 5, 1), (510, [0.3] * 3, 1), (511, [0.3] * 3, 1), (512, [0.25] * 3, 2)]
    rows += [(600, [], 1), (601, [], 1), (602, [], 2)]
    # large numbers, for which floats of either width are not exact
    rows += [(700, [2000.0 * 256, 1.5, 0, 0, 0], 8), (701, [2000.0 * 256, -1.25, 3, 0, 0], 8), (702, [1900.0 * 256, 7, 7, 7, 7], 9)]
    rows += [(710 + i, [float(i), 40000.0, 3.0 * i, 1.0, -9.0], 8 + i % 2) for i in range(12)]
    got = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, batch_anchors=4)
    assert sorted(map(tuple, got.collect())) == expected_negatives(rows, 10)
    assert hardneg.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.mine(vectors(spark, rows), F.lit(False)).count() == 0


def test_repeated_rows_are_candidates_of_their_own(spark):
    rows = vector_rows(6, 60, 4) + vector_rows(6, 60, 4)
    got = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == expected_negatives(rows, 10)


def test_zones_leave_out_blocks_of_clustered_rows(spark, monkeypatch):
    rows = vector_rows(8, 4000, 4, centres=20, spread=0.02)
    df = vectors(spark, rows)
    read = []
    chosen = hardneg._chosen
    monkeypatch.setattr(hardneg, "_chosen", lambda table, blocks: read.append((blocks.count(), table.zones.count())) or chosen(table, blocks))
    got = hardneg.mine(df, F.col("vec_id") == 50, block_rows=16)
    assert sorted(map(tuple, got.collect())) == [r for r in expected_negatives(rows, 50) if r[0] == 50]
    assert len(read) == 4 and all(some < all_ / 2 for some, all_ in read), read


def test_the_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hardneg.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(side**dims))
        path = cells[np.argsort(place)].astype(int)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
