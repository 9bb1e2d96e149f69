"""Operators that work text by text, against plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semcat.llm import factorisation, langid, licenses, packing, quoting, recurrent, thresholds, urlrules
from semcat.llm.rows import fold

ODD = [(1, None), (2, ""), (3, " \n "), (4, "é ü"), (4, "é ü"), (None, "null id"), (6, "word " * 30000)]


def test_packing_is_whole_and_gapless(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = ODD + [(10 + i, " ".join(rng.choice(["the", "Über", "a1", "<|endoftext|>x", "\n\t", "日本"]) for _ in range(rng.randrange(700)))) for i in range(60)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.pack(docs(rows), keep_ids=True).collect()
    texts = {}
    for r in got:
        texts.setdefault((r.doc_id, r.start + 0), []).append(r)
    want = sorted((str(i), *tok.encode(t or "", add_special_tokens=False).ids, 2) for i, t in rows if i != 4)
    whole = {}
    for r in sorted(got, key=lambda r: r.piece):
        if r.doc_id != 4:
            whole.setdefault(str(r.doc_id), []).extend(r.ids)
    assert sorted((k, *v) for k, v in whole.items()) == want
    by_sequence = {}
    for r in got:
        assert r.length == len(r.ids) <= 1024 and (r.piece == 0 or r.length == 1024)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs([])).count() == 0


def test_plan_stays_near_the_least_number_of_sequences():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1025, 40000), minlength=1025)
    histogram[0] = 0
    bins = packing.plan(histogram)
    used = np.zeros(1025, np.int64)
    for b in bins:
        assert sum(b.lengths) + b.gap == 1024 and b.gap >= 0
        for x in b.lengths:
            used[x] += b.count
    assert (used == histogram).all()
    least = -(-(histogram * np.arange(1025)).sum() // 1024)
    assert sum(b.count for b in bins) <= 1.01 * least
    assert packing.plan(np.zeros(1025, np.int64)) == []


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def test_rule_counts(docs):
    rng = random.Random(2)
    rows = [r for r in ODD if r[0] != 6]
    rows += [(20 + i, "".join(rng.choice(["a ", "b ", "é ", "\n", "c#", "|", "\t", "A.", "\u00a0"]) for _ in range(rng.randrange(150)))) for i in range(60)]
    got = thresholds.measured(docs(rows).select("doc_id", "text")).select("doc_id", "text", "_m.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.02), (3, 200, 0.01), (40, 9000, 0.005), (900, 200000, 0.005), (5, 5, 0.5)])
def test_binomial_bound(spark, k, n, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    got = spark.range(1).select(thresholds._chance_of_so_few(F.lit(k), F.lit(n), p).alias("p")).first().p
    assert got == pytest.approx(exact, rel=1e-6, abs=1e-12)


def test_rules_keep_good_texts(docs, labels):
    rng = random.Random(4)
    good = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(80)) + " a & b") for i in range(1500)]
    bad = [(2000 + i, " ".join(f"w{rng.randrange(5000)}###" for _ in range(80))) for i in range(50)]
    marks = labels([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 0)])
    table = docs(good + bad + ODD[:6])
    judged = thresholds.judge(table, marks)
    assert judged.columns == [*table.columns, "quality_rules"] and judged.count() == 1556
    kept = {r.doc_id for r in judged.filter("quality_rules.kept").collect()}
    assert len([i for i, _ in good if i in kept]) >= 0.98 * 1500 and not any(i in kept for i, _ in bad)
    # without labels only the base rules judge; nothing gives nothing
    assert thresholds.judge(table, labels([])).filter("quality_rules.kept").count() == 1550
    assert thresholds.judge(docs([]), marks).count() == 0


def test_factorisation_machine(docs, labels):
    rng = random.Random(6)
    rows = [(i, " ".join(("good%d" if i % 3 else "BAD%d!!") % rng.randrange(30) for _ in range(30))) for i in range(400)]
    marks = labels([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 1)])
    table = docs(rows + ODD)
    model = factorisation.train(table, marks)
    got = factorisation.classify(table, model)
    assert set(got.columns) == {*table.columns, "predicted"}
    rows = got.collect()
    assert len(rows) == 407 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [r for r in rows if (r.doc_id or 0) >= 10]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in own]) > 0.98
    assert factorisation.classify(docs([]), model).count() == 0
    alone = factorisation.train(docs([]), labels([]))
    assert [r.score for r in factorisation.classify(docs([(1, "x")]), alone).collect()] == [0.5]


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = factorisation.Model(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = rng.normal(size=9)
    pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    got = model.raw(np.array([0, 9]), np.arange(9), x)
    assert got[0] == pytest.approx(0.3 + model.weights @ x + pairs)


def test_language(docs):
    en, de = "the and of this that is ", "der und die nicht ein ist "
    rows = [(i, (en, de)[i % 2] * (1 + i % 7)) for i in range(60)] + ODD + [(90, "123 !?"), (91, "the")]
    langs = [("en", "de")[i % 2] for i in range(60)] + [None] * 9
    table = docs(rows, langs)
    got = langid.identify(table, langid.train(table)).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(found[i][0] == ("en", "de")[i % 2] for i in range(10, 60))
    assert [found[i] for i in (1, 2, 3, 90)] == [("und", 0.0)] * 4 and found[91][0] == "en"
    none = langid.train(docs([]))
    assert [r.lang_pred for r in langid.identify(docs([(1, "x")]), none).collect()] == ["und"]


def test_ngrams_are_those_of_the_text():
    texts = ["Ab  c1d", None, "", "É", "xyz " * 3]
    col = pa.array(texts)
    from semcat.llm import textvec as tv

    alone = [langid._ngrams(*next(iter(tv.slices(pa.array([t], pa.string()))))[2:])[0].tolist() for t in texts]
    _, _, data, offsets = next(iter(tv.slices(col)))
    bucket, first, _ = langid._ngrams(data, offsets)
    assert [bucket[a:b].tolist() for a, b in zip(first, first[1:])] == alone


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://net/", "ftp://evilnet/", "http://net", None, "", "no scheme", "http://x.org/fr/\nz", "a://b.net/c://d", "http://u.com/casino", "http://" + "l" * 9000 + ".net/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    rules = [urlrules.site_rule("net/", "block"), urlrules.site_rule("example.net/en/", "allow"), urlrules.url_globs("c", "block", "*casino*")]
    got = {r.page_id: r for r in urlrules.judge(pages, rules, "allow").collect()}
    assert [got[i].rule for i in range(11)] == ["example.net/en/", "net/", None, None, None, None, None, None, "net/", "c", "net/"]
    assert got[0].host == "a.example.net" and got[0].path == "/en/x" and got[8].path == "/c://d" and got[7].path == "/fr/\nz"
    assert urlrules.judge(pages.limit(0), rules, "allow").count() == 0
    assert urlrules.judge(pages, [], "allow").filter("verdict = 'allow' and rule is null").count() == 11


def test_site_rules_hold_for_the_host_and_the_start_of_the_path(spark):
    names = ["net/", "example.net/en/", "org/fr/", "example.com/de/", "example.org"]
    urls = ["http://u.com/web/http://www.foo.net/x", "https://u.com/a.net/b", "http://u.com/x.example.net/en/", "http://u.com/net/",
            "http://u.com/a.org/fr/", "http:///a.net/", "http://example.org", "http://example.organic/", "http://a.example.org/x?y", "http://u.com/.example.org"]
    rng = random.Random(9)
    part = lambda: rng.choice(["net", "example", "org", "com", "u", "x.example", "en", "fr", "de"])
    urls += ["http://" + "".join(part() + rng.choice("../") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "/", "?a.net/"]) for _ in range(500)]

    def plain(url):
        host, path = re.match(r"[^/]*://([^/?#]*)([^?#]*)", url).groups()
        split = [(n, *re.match(r"([^/]*)(.*)", n).groups()) for n in names]
        fits = [n for n, h, p in split if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=len, default=None)

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.rule for r in urlrules.judge(pages, [urlrules.site_rule(n, "block") for n in names], "allow").collect()}
    assert [got[i] for i in range(len(urls))] == [plain(u) for u in urls]
    assert [got[i] for i in range(10)] == [None] * 6 + ["example.org", None, "example.org", None]


def test_globs_against_patterns():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?.") for _ in range(rng.randrange(45))) for _ in range(70)]
    texts = ["".join(rng.choice("ab./é") for _ in range(rng.randrange(30))) for _ in range(300)]
    got = urlrules.Automaton(globs).fitting(texts)
    for j, g in enumerate(globs):
        pattern = re.compile("(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) + r")\Z")
        assert [bool(pattern.match(t)) for t in texts] == got[:, j].tolist(), g


def test_licenses(docs):
    notice = "Released under the MIT License."
    rows = ODD + [(20, f"Some text. {notice} More."), (21, "Released under terms of the MIT License."), (22, "No license is given here."), (23, f"{notice}\n\nA.\nB.\nC.\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: [(x.license, x.missing, x.other) for x in r.licenses] for r in licenses.scan(docs(rows)).collect()}
    assert got[20] == [("MIT", 0, 0)] and got[21] == [("MIT", 0, 2)] and got[22] == [(None, None, None)]
    assert [x[0] for x in got[23]] == ["MIT", "CC-BY-NC-4.0"] and got[1] == got[2] == got[6] == []
    assert licenses.scan(docs([])).count() == 0


def test_several_licenses_in_one_block():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    named = lambda text: [x["license"] for x in scanner.scan(text)]
    assert named("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert named("Released under the MIT License or licensed under CC BY 4.0, as you like.") == ["MIT", "CC-BY-4.0"]
    notices = [t for t in licenses.TEMPLATES if len(t.text) < 90]
    for sep in ("\n", " ", "\n\n"):
        for some in (notices, notices[::-1], notices * 20):
            got = scanner.scan(sep.join(t.text for t in some))
            assert [(x["license"], x["missing"], x["other"]) for x in got] == [(t.name, 0, 0) for t in some]
    assert named("Released under the MIT License. Licensed under terms of our own.") == ["MIT", None]
    text = "x. " * 50 + "Released under the MIT License. " + "y. " * 900 + "All of this is copyright of nobody."
    assert [(x["license"], text[x["start"] : x["end"]]) for x in scanner.scan(text)] == [
        ("MIT", "Released under the MIT License"), (None, " All of this is copyright of nobody.")]


def test_license_bodies():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    named = lambda text: [x["license"] for x in scanner.scan(text)]
    wrap = lambda text, n=9: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    for t in licenses.BODIES:
        for n in (9, 10**6):
            got = scanner.scan(f"Some words before.\n\n{wrap(t.text, n)}\n\nAnd words behind.")
            assert [(x["license"], x["missing"], x["other"]) for x in got] == [(t.name, 0, 0)]
        # small changes of wording
        words = t.text.split()
        free = [i for i, w in enumerate(words) if i % 17 == 5 and not set(licenses._words(w)) & set(t.names)]
        changed = " ".join("thing" if i in free else w for i, w in enumerate(words))
        assert named("\n# ".join(wrap(changed).split("\n"))) == [t.name]
    mit = next(t.text for t in licenses.BODIES if t.name == "MIT")
    assert named("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(mit)) == ["MIT"]


def test_quotations(spark):
    rows = [
        (1, 0, "user", "First thing.\nSecond line"), (1, 1, "assistant", "> first THING.\n> second   line\nanswer one"),
        (1, 2, "user", "other topic"), (1, 3, "user", ">> First thing.\n> answer one\nfollow up"),
        (1, 4, "user", "> Other topic\nyes"), (1, 5, None, "> never said\nwell"), (2, 0, "user", "> First thing.\nhi"),
        (None, 1, "user", "> a"), (3, None, "user", None), (3, 0, "user", ""), (1, 2, "user", "other topic"),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, _conv string, body int")
    got = quoting.threads(table)
    assert set(table.columns) <= set(got.columns)
    found = got.collect()
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): r for r in found}
    assert [by[1, t].parent_turn for t in range(6)] == [None, 0, None, 1, 2, None]
    assert [by[1, t].root_turn for t in range(6)] == [0, 0, 2, 0, 2, 5]
    order = [r.turn for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 3, 2, 2, 4, 5]
    assert by[1, 3].body == "follow up" and by[1, 3].quotes == 2 and by[1, 1].chat == "<|assistant|>\nanswer one"
    assert by[2, 0].parent_turn is None and quoting.threads(table.limit(0)).count() == 0


def test_language_model(docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice([f"the{i % 2}", f"cat{i % 2}", "sat.", "On"]) for _ in range(rng.randrange(80)))) for i in range(300)]
    rows += ODD[:6] + [(1000, "never seen words " * 3), (1001, "the0 " * 3000)]
    table = docs(rows)
    got = recurrent.score(table, fold("doc_id", 7, 2), head_words=3).collect()
    learned = [t for i, t in rows if not (i is not None and __import__("zlib").crc32(str(i).encode()) % 7 == 2)]
    counts = {}
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    for t in learned:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)), 5))
        for _, t in rows
    )
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert recurrent.score(docs([]), fold("doc_id", 7, 2)).count() == 0


def test_state_is_carried_across_windows_and_gradients_are_right():
    rng = np.random.default_rng(2)
    network = recurrent.Network.fresh()
    texts = [rng.integers(0, recurrent.CLASSES, n).astype(np.uint8) for n in (1, 100, 17, 40)]
    got = recurrent._scores(network, texts)
    for text, score in zip(texts, got):
        h, total, before = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0, recurrent.START
        for y in text:
            states, h = network.states(np.array([[before]], np.uint8), h)
            e, s = network.log_shares(states[0])
            total += math.log10(e[0, y] / s[0])
            before = y
        assert score == pytest.approx(total, rel=1e-4)
    # one step of learning against differences of the loss
    one = [texts[2][:10]]
    parts = network.parts()
    loss = lambda: -recurrent._scores(network, one)[0] * math.log(10) / 10
    want = {}
    for p, place in ((0, (recurrent.START, 3)), (1, (2, 40)), (2, (5, int(one[0][0]))), (1, (0, 5))):
        keep = parts[p][place]
        parts[p][place] = keep + 1e-2
        up = loss()
        parts[p][place] = keep - 1e-2
        want[p, place] = (up - loss()) / 2e-2
        parts[p][place] = keep
    before = [p.copy() for p in parts]
    seen = [np.full_like(p, 1e12) for p in parts]
    recurrent._learn(network, seen, one, 1e6 * 1e-3)
    for (p, place), slope in want.items():
        assert (before[p][place] - parts[p][place]) / 1e-3 == pytest.approx(slope, rel=0.1, abs=2e-3)


def test_no_window_is_repeated_by_chance(spark):
    numbers = F.transform(F.sequence(F.lit(1), F.lit(4_000_000)), lambda i: F.conv(i, 10, 36))
    df = spark.range(1).select(F.array_join(numbers, " ").alias("text"), F.array_join(F.concat(numbers, F.slice(numbers, 7, 5)), " ").alias("again"))
    assert thresholds.measured(df, "text").first()._m.n_repeat_words == 0
    assert thresholds.measured(df, "again").first()._m.n_repeat_words == 10
