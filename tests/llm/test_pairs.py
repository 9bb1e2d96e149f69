"""Chosen-path join and winnowing against brute force."""

import random
import re

import pytest

from semcat.llm import chosenpath, components, winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0))}


def sample(seed, n):
    """Texts with exact copies, near copies, nulls, empties, short ones and a long one."""
    rng = random.Random(seed)
    prose = lambda size: " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(size))
    rows = []
    for _ in range(n):
        base = prose(rng.randrange(8, 90))
        rows.append(base)
        for _ in range(rng.randrange(3)):
            w = base.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += [None, "", "  ", "One two", "one, TWO!", "é", prose(5000), prose(12)]
    rows += rows[:3]
    return list(enumerate(rows))


def expected_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    near = {
        i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])]
        for i in sets
    }
    seen = {}
    for i in sorted(sets):
        todo = [] if i in seen else [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                todo += near[x]
    return {i: (seen[i], len(near[i])) for i in sets}


@pytest.mark.parametrize("small_buckets", [False, True])
def test_join_finds_every_link(docs, monkeypatch, small_buckets):
    if small_buckets:  # then buckets are split, and groups cut into blocks
        monkeypatch.setattr(chosenpath, "BUCKET", 1)
        monkeypatch.setattr(chosenpath, "BUCKET_PAIRS", 1)
        monkeypatch.setattr(chosenpath, "BLOCK_SETS", 2)
    rows = sample(3, 40)
    got = chosenpath.similarity_join(docs(rows)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == expected_classes(rows)


def test_join_of_repeated_rows_null_ids_and_nothing(docs):
    text = "a b c d e f g"
    got = chosenpath.similarity_join(docs([(5, text), (5, text), (None, text), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [
        ("5", "5", 2), ("5", "5", 2), ("None", "5", 2), ("None", "None", 0),
    ]
    assert chosenpath.similarity_join(docs([])).count() == 0


def test_runs_reach_the_target_recall():
    assert chosenpath.runs_needed(0.999) > chosenpath.runs_needed(0.9) > 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def expected_hits(rows, items):
    out = []
    windows = []
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        if n and item is not None:
            windows += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 4])
def test_winnowing_finds_every_window(spark, docs, blocks):
    rng = random.Random(blocks)
    prose = lambda n: " ".join(rng.choice("abc") + str(rng.randrange(9)) for _ in range(n))
    items = [(i, prose(rng.randrange(10, 40))) for i in range(12)]
    items += [(20, items[0][1]), (21, "Only four words here"), (22, "x y z"), (23, ""), (24, None), (None, prose(15)), (3, "x y z")]
    rows = [(i, prose(60) + " " + items[i % 12][1][: rng.randrange(200)].upper() + " " + prose(9)) for i in range(30)]
    rows += [(90, None), (91, ""), (92, "so: only FOUR words, here."), (93, "x y z x y z"), (None, "x y z"), (0, rows[0][1])]
    rows += [(94, prose(4000) + " " + items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    size = winnowing.BLOCK_BYTES if blocks == 1 else 20_000
    got = winnowing.decontaminate(docs(rows), benchmark, block_bytes=size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == expected_hits(rows, items)


def test_winnowing_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in winnowing.decontaminate(docs([(1, "a b")]), none).collect()] == [(1, 2, 0)]
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert winnowing.decontaminate(docs([]), some).count() == 0


def test_ids_of_any_type(spark, docs):
    rows = [("u-2", "a b c d e f g"), ("u-1", "a b c d e f g"), ("u-10", "other words stand in this one"), (None, "a b c d e f g")]
    rows += [("u-3", None), ("u-3", ""), ("u-4", "...")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in chosenpath.similarity_join(df).collect()), key=repr)
    want = [("u-2", "u-1", 2), ("u-1", "u-1", 2), ("u-10", "u-10", 0), (None, "u-1", 2), ("u-3", "u-3", 0), ("u-3", "u-3", 0), ("u-4", "u-4", 0)]
    assert got == sorted(want, key=repr)
