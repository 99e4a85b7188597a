"""Whitening, ranked search and license scans against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from seqframe.llm import licenses, queries, ranked_search, whitening
from seqframe.llm.words import words_of

LETTERS = "abcdefghijklmnopqrstuvwxyz"
NAN, INF = float("nan"), float("inf")


def brute_whitening(vectors, k):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    far = n * x - s
    c = far.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(e)[::-1][:k]
    return (far * far).sum(1), c @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("block_bytes", [1 << 21, 600])
def test_whitening_against_numpy(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(90, 10)) * np.linspace(3, 0.2, 10)).round(4).tolist()
    good += [good[0], good[0]]  # repeated rows
    bad = [None, [1.0, None] + [0.0] * 8, [NAN] + [0.0] * 9, [INF] + [0.0] * 9, [1e30] + [0.0] * 9, [], [1.0, 2.0]]
    rows = [(i, v, "n", 1) for i, v in enumerate(good)] + [(1000 + i, v, "n", 1) for i, v in enumerate(bad)]
    rows[5], rows[6] = (None, *rows[5][1:]), (7, *rows[6][1:])  # a null and a repeated id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, r int").repartition(5)
    out, fit = whitening.whiten(df, 8)
    far, white, explained = brute_whitening(good, 8)
    got = out.collect()
    assert len(got) == len(good) == fit.n and fit.identity_error < 1e-9
    assert fit.explained == pytest.approx(explained.tolist(), rel=1e-9)
    by_id = {r.vec_id: r for r in got if r.vec_id not in (None, 7)}
    signs = np.sign(np.array(by_id[0].whitened) * white[0])
    for i in by_id:
        assert int(by_id[i].deviation) == far[i]
        assert np.array(by_id[i].whitened) * signs == pytest.approx(white[i], rel=1e-6, abs=1e-8)
    assert sorted(int(r.deviation) for r in got if r.vec_id == 7) == sorted([far[6], far[7]])
    assert {int(r.deviation) for r in got if r.vec_id is None} == {far[5]}
    flat = whitening.component_rows(out, fit)
    assert flat.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and flat.count() == 8 * len(good)


def test_whitening_of_few_rows_and_large_entries(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    out, fit = whitening.whiten(empty)
    assert out.count() == 0 and whitening.component_rows(out, fit).count() == 0
    one = spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    out, fit = whitening.whiten(one)
    assert [(r.vec_id, int(r.deviation), r.whitened) for r in out.collect()] == [(1, 0, [])] and whitening.component_rows(out, fit).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], "vec_id long, embedding array<double>")
    out, fit = whitening.whiten(line, 3)  # rank 1: one component
    assert fit.explained == pytest.approx([1.0]) and {len(r.whitened) for r in out.collect()} == {1}
    far = spark.createDataFrame([(i, [i * 2.0 ** 41, 1.0, i * i * 1.0]) for i in range(2)], "vec_id long, embedding array<double>")
    want, _, _ = brute_whitening([[i * 2.0 ** 41, 1.0, i * i * 1.0] for i in range(2)], 1)
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(far, 1)[0].collect()} == dict(enumerate(want))


def test_op11_on_given_rows(spark):
    df = queries.QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001")
    vectors = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()]
    far, white, explained = brute_whitening(vectors, 8)
    rows = df.orderBy("vec_id", "component").collect()
    assert len(rows) == 8 * len(vectors) and dict(df.dtypes)["deviation"] == "bigint"
    got = np.array([r.whitened for r in rows]).reshape(-1, 8)
    assert np.abs(got) == pytest.approx(np.abs(white), rel=1e-6, abs=1e-6) and [r.deviation for r in rows[::8]] == far.tolist()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        best = []
        for d, c in counts:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * n_docs) // total)))
                        for t in terms(text) if c[t])
            if score > 0:
                best.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, b[3], -b[0]) for i, b in enumerate(sorted(best, key=lambda b: b[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells,batch", [(4096, 256), (8, 5)])
def test_search_against_brute_force(spark, monkeypatch, cells, batch):
    """Few cells make loose bounds and small batches many thresholds: results stay the same."""
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "BATCH_DOCS", batch)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(LETTERS[:6]) for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(60)]  # ties
    docs += [(400, None), (401, ""), (402, " .,;{}\x7f"), (None, docs[6][1]), (None, None), (403, "Abc ÉÀ abc x 12"), (404, "ab " * 30000)]
    docs += [docs[9], docs[9]]
    items = [(i, docs[rng.randrange(300)][1] + " " + word()) for i in range(12)] + [(5, docs[5][1]), (None, "abc 12"), (50, None), (51, "zzzz9"), (52, "ab ab ab a")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score int, item_id int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.search(d, q, 20).collect()]
    want = brute_search(docs, items, 20)
    assert sorted(got, key=repr) == want
    assert ranked_search.search(d.limit(0), q).count() == 0 and ranked_search.search(d, q.limit(0)).count() == 0


def test_sketch_bounds_hold_and_skip_most_documents():
    rng = random.Random(1)
    vocab = ["".join(rng.choice(LETTERS) for _ in range(5)).encode() for _ in range(3000)]
    docs = [Counter(rng.choices(vocab, k=200)) for _ in range(400)]
    items = [[(t, rng.randint(1, 9000)) for t in rng.sample(vocab, 30)] for _ in range(5)]
    searcher = ranked_search.Searcher(items, 400, 400 * 200, 3)
    m = ranked_search.length_factor(200, 400, 400 * 200)
    bounds = searcher.bounds(np.stack([searcher.sketch(c, m) for c in docs]))
    exact = np.array([[searcher.score(i, c, m) for i in range(5)] for c in docs])
    assert (bounds >= exact).all()
    scored = []
    own = searcher.score
    searcher.score = lambda i, c, length: scored.append(i) or own(i, c, length)
    searcher.add([(i, c, 200) for i, c in enumerate(docs)])
    assert len(scored) < 400 * 5 / 4
    for i in range(5):
        assert sorted(s for s, _ in searcher.best[i]) == sorted(exact[:, i])[-3:]


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_words(text):
    return LICENSE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w = license_words(text)
    found = [(i, x) for p, x in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute_labels(text):
    """All labels with a run of words near enough to their template."""
    w = [x.encode() for x in license_words(text)]
    out = set()
    for t in licenses.templates_of():
        n = len(t.words)
        if any(edits(t.words, w[i:j]) <= t.edits for i in range(len(w)) for j in range(i + n - t.edits, min(len(w), i + n + t.edits) + 1)):
            out.add(t.label)
    return ",".join(sorted(out))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[i] = "zz"
        elif kind == 1:
            del words[i]
        else:
            words.insert(i, rng.choice(["zz", words[i]]))
    return words


def test_licenses_against_brute_force(spark):
    rng = random.Random(11)
    filler = [p for t, _ in licenses.PHRASES + licenses.NOTICES for p in t.split()] + ["foo", "bar"] * 20
    texts = [None, "", " ", "mit", "cc by", "CC BY-NC", "cc by nc cc by nc 4.0 by nc", "Under the MIT License, Version 2; APACHE license,version 2.0!",
             "under the mit\x00license", "cc é by nc", "ccby nc", "cc by-nc " * 3000, "İ under the mit license"]
    for t, _ in licenses.NOTICES + licenses.PHRASES:
        n = len(t.split())
        for k in (0, 1, n // 5, n // 5 + 1, n // 2):
            for _ in range(2):
                around = [rng.choice(filler) for _ in range(rng.randint(0, 30))]
                texts.append(" ".join(around) + " " + " ".join(changed(rng, t.split(), k)).title() + ". " + " ".join(around[::-1]))
    texts += [" ".join(rng.choice(filler[:60]) for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[7], "x", 1), (3, texts[7], "x", 1), (3, texts[7], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int").repartition(6)
    got = licenses.license_summary(licenses.scan_licenses(df)).collect()
    assert len(got) == len(rows)
    def name(r):
        return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
    want = Counter((i, *brute_base(t), brute_labels(t) if t is None or len(t) < 2000 else "cc-by-nc") for i, t, *_ in rows)
    assert Counter((r.doc_id, *name(r)) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and (r.score == 1 or not r.n_base)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_spans_and_templates(spark):
    text = "x y " + licenses.NOTICES[0][0].replace("obtaining a copy", "obtaining one copy") + " z"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    n = len(licenses.NOTICES[0][0].split())
    assert [(s.label, s.exact, s.start, s.end) for s in row.spans] == [("mit", False, 2, 2 + n)] and row.spans[0].similarity == pytest.approx(1 - 1 / n)
    with pytest.raises(ValueError):
        licenses.templates_of(phrases=[("two words", "x")])
    with pytest.raises(ValueError):
        licenses.templates_of(notices=[("one two three four five six", "x")], edit_percent=50)
    assert words_of("A-é b{c}\x7f1") == ["a".encode(), "é".encode(), b"b", b"c", b"1"]


def test_new_queries_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_ranked_search"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == brute_search(docs, items, 20)
    rows = queries.QUERIES["op13_license_scan"](spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {d: brute_base(t) for d, t in docs}
    assert any(r.n_base for r in rows)
    gpl = {d for d, t in docs if "licensed under the gnu general public license" in " ".join(license_words(t))}
    assert {r.doc_id for r in rows if "gpl" in r.labels.split(",")} == gpl
