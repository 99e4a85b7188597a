"""Jaccard join, components, repeated passages, benchmark passages, pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from seqframe.llm import common, decontam, graph, jaccard, passages, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.choice([5, 30, 60, 120]))] for _ in range(25)]
    shared = [word() for _ in range(30)]
    texts = [None, "", " \n", "One two", "one TWO", "a b c d e", "A b\tc d\x0be", "x " * 3000]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 12)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [" ".join([word() for _ in range(40)] + shared + [word() for _ in range(5)]) for _ in range(12)]
    rng.shuffle(texts)
    return texts


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("short,frequent", [(64, 16), (3, 2)])
def test_similar_documents_against_all_pairs(spark, short, frequent):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sid long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, short=short, frequent=frequent, leaders=2).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_similar_documents_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (None, None)], "doc_id long, text string")
    rows = jaccard.similar_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in rows if r.n_shingles) == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 4)]
    assert [r.component_id for r in rows if not r.n_shingles] == [None]
    assert jaccard.similar_documents(docs.limit(0)).count() == 0


def test_similar_documents_with_small_buffers(spark, monkeypatch):
    """Full count tables and long texts change the work only."""
    monkeypatch.setattr(jaccard, "_MAX_COUNTED", 50)
    monkeypatch.setattr(jaccard, "_MAX_SEEN", 3)
    texts = near_copies(8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, short=3, frequent=2, leaders=2).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_large_group_makes_few_candidates(spark, monkeypatch):
    """120 sets that share most shingles and do not link, and 20 that do: candidates do not grow with the pairs."""
    rng = np.random.default_rng(5)
    base, texts, made = [f"w{i}" for i in range(104)], [], []
    for i in range(140):
        own = list(base)
        for j in (rng.choice(range(5, 99, 6), 2, replace=False) if i < 120 else [(i % 4) * 20 + 7, (i % 4) * 20 + 13]):
            own[j] = f"x{i}y{j}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    link = jaccard.Join.link

    def counted(self, pairs, found=None):
        made.append(pairs.distinct().count())
        link(self, pairs, found)

    monkeypatch.setattr(jaccard.Join, "link", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, short=8, leaders=2).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(made) == 2 and made[1] < 140 * 139 / 2 / 4
    texts = [t for t in texts[:120]]
    members = spark.createDataFrame([(0, jaccard.set_print(jaccard.Shingler().prints(t)), 100) for t in texts], "main long, sid long, n long")
    rows = jaccard._texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    join = jaccard.Join(rows, jaccard.index_sets(rows, np.zeros(0, np.uint64), 5, 80), 5, 80)
    join.link_groups(members.withColumn("component", members.sid))
    assert made[2] < 120 * 119 / 2 / 4


def test_sets_that_share_a_passage_alone_are_not_read(spark, monkeypatch):
    """In long lists of sets that have little else in common, only those are read whole that may link; results as by all pairs."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(24)]
    texts = [" ".join([word() for _ in range(rng.randint(300, 1500))] + passage + [word() for _ in range(20)]) for _ in range(80)]
    for t in texts[:6]:  # parts of others: linked with them, or just not
        texts += [" ".join(t.split()[:round(len(t.split()) * x)]) for x in (0.78, 0.83, 0.9)] + [t + " " + word()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    read, sets_of = [], jaccard.Join.sets

    def counted(self, wanted):
        read.append(wanted.distinct().count())
        return sets_of(self, wanted)

    monkeypatch.setattr(jaccard.Join, "sets", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, short=8, leaders=2, frequent=1000).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert max(read) < 50  # 86 before


@pytest.mark.parametrize("short,frequent", [(2, 2), (4, 1000)])
def test_links_of_sparse_and_dense_sets(spark, short, frequent):
    """Parts of texts of all lengths around the bound, with passages that many hold, so that most lists are long."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages, texts = [[word() for _ in range(rng.randint(6, 30))] for _ in range(4)], []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(10, 70))] + rng.choice(passages) + [word() for _ in range(rng.randint(0, 30))] + rng.choice(passages)
        for _ in range(7):
            own = base[:max(4, round(len(base) * rng.uniform(0.7, 1)))]
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own + [word() for _ in range(rng.randint(0, 4))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, short=short, frequent=frequent, leaders=1).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_slices_hold_every_row_once():
    rows = [None, "", "é" * 50, "a" * 99, "b", None, "c" * 300, ""]
    batch = common.pa.RecordBatch.from_arrays([common.pa.array(rows)], names=["text"])
    for n in (1, 100, 10_000):
        parts = list(common.sliced(batch, 0, n))
        assert [x for p in parts for x in p.column(0).to_pylist()] == rows
    assert not list(common.sliced(batch.slice(0, 0), 0))


def test_discard_removes_the_table_alone(spark):
    a, b = (common.written(spark.range(5), "t") for _ in range(2))
    common.discard(a)
    assert b.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(a.written_to).count()


def test_prefix_bound_holds(spark):
    rng = np.random.default_rng(1)
    join = jaccard.Join(None, None, 5, 80)
    pairs = []
    for _ in range(300):
        n, drop, more = rng.integers(2, 80), 0, 0
        drop, more = rng.integers(0, max(1, n // 6)), rng.integers(0, max(1, n // 6))
        u = rng.permutation(400)
        x, y = u[:n], np.concatenate([u[drop:n], u[n:n + more]])
        if len(y) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            prefix = lambda s: np.sort(s)[: len(s) - (80 * len(s) + 99) // 100 + 1]
            pairs.append((len(x), len(y), len(np.intersect1d(prefix(x), prefix(y)))))
    df = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a long, b long, met long")
    assert len(pairs) > 50 and df.where(df.met < join.shared_needed(df.a, df.b)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(300, 300)] + [(7, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in [*range(41), 200, 201]} == {0} and {got[x] for x in range(100, 160)} == {100} and got[300] == 300
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows):
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        cover = np.zeros(len(t), bool)
        for j in range(len(t) - 49):
            w = t[j:j + 50]
            if first.setdefault(w, i) < i:
                cover[j:j + 50] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int(cover[:1].sum()) + int((cover[1:] & ~cover[:-1]).sum())
        out.setdefault(i, []).append((len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [2_000, 8 << 20])
def test_repeated_passages_against_brute_force(spark, block_bytes):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    common = [" ".join(word() for _ in range(n)) for n in (10, 14, 20, 40, 120)]
    texts = ["", "a" * 49, "a" * 50, "a" * 300, "ab" * 200, common[4]] + [common[4]] * 5
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            lo = rng.randint(0, len(c) // 2)
            parts += [c[lo:lo + rng.randint(20, 200)], word() * rng.randint(0, 5)]
        texts.append("".join(parts))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, common[4]), (3, common[3] + common[2]), (500, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = defaultdict(list)
    for r in passages.remove_repeats(docs, block_bytes=block_bytes, bucket_bytes=3_000).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = removed([(i, (t or "").encode()) for i, t in rows])
    assert {i: sorted(x) for i, x in got.items() if i is not None} == {i: sorted(x) for i, x in want.items()}
    assert got[None][0][1] == 0
    assert passages.remove_repeats(docs.limit(0)).count() == 0


def test_texts_of_a_block_are_taken_together(monkeypatch):
    import pyarrow as pa
    rng = random.Random(12)
    shared = ["".join(rng.choice("abcd") for _ in range(n)) for n in (50, 51, 77, 400)]
    texts = ["".join(rng.choice([*shared, "".join(rng.choice("abcd") for _ in range(40))]) for _ in range(rng.randint(1, 4))).encode() for _ in range(400)]
    rows = [*enumerate(texts), (7, texts[3]), (401, b"a" * 49), (402, b""), (403, b"\xff" * 50)]
    table = lambda rows: pa.table({"block": pa.array([0] * len(rows), pa.int32()), "doc_id": pa.array([i for i, _ in rows], pa.int64()),
                                   "t": pa.array([t for _, t in rows], pa.binary())})
    parts = list(passages._parts(table(rows)))
    assert len(parts) <= 1 + sum(map(len, texts)) // passages.TAKEN  # and not one a text
    seen = {}
    for x in parts:
        text = x.prints.text.tobytes()
        for at, d, first, last in zip(x.at.tolist(), x.doc.tolist(), x.first.tolist(), x.last.tolist()):
            assert x.prints.starts[d] <= first and last + passages.LENGTH <= x.prints.ends[d]
            for w in range(first, last + 1):
                assert 0 <= at - w <= passages.STRETCH - 1 and seen.setdefault(text[w:w + 50], at - w) == at - w
    assert sum(len(t) - 49 for _, t in rows if len(t) > 49) == sum(int((x.last - x.first + 1).sum()) for x in parts)
    for taken in (60, 1000, 1 << 16):  # whatever is taken at a time, the result is that of brute force
        monkeypatch.setattr(passages, "TAKEN", taken)
        told = pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "smaller": pa.array([], pa.binary()),
                         "shared": pa.array([], pa.binary()), "round": pa.array([], pa.int32())})
        got = defaultdict(list)
        for i, *r in passages._finished(table(rows), told, 1, False):
            got[i].append(tuple(r))
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in removed(rows).items()}
    assert not len(passages.Rounds(table([(1, b"short"), (None, b"a" * 80)]), 1).grams())


def least_edits(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_nearest_is_the_least_edit_distance():
    rng = random.Random(7)
    for _ in range(800):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        assert decontam.nearest(a, b)[0] == least_edits(a, b)


def test_leaks_recall_and_precision(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(rng.randint(15, 60))) for k in range(40)]
    rows, truth = [], set()
    for d in range(200):
        item, own = rng.choice(items)
        own = list(own)
        if d % 2:
            for _ in range(rng.randint(0, len(own) // 5)):
                p, o = rng.randrange(len(own)), rng.random()
                own[p:p + 1] = [[rng.choice(vocab)], [own[p], rng.choice(vocab)], []][int(o * 3)]
            rows.append((d, " ".join([*text(rng.randint(0, 80)), *own, *text(rng.randint(0, 80))]).upper()))
        else:
            rows.append((d, " ".join(text(rng.randint(0, 200)))))
    words = {d: t.lower().split() for d, t in rows}
    for d in words:
        for k, own in items:
            if least_edits(own, words[d]) <= decontam.edits_allowed(len(own), 80):
                truth.add((d, k))
    docs = spark.createDataFrame([*rows, (None, " ".join(items[0][1])), (900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items] + [(70, None), (71, ""), (72, " .,;")], "item_id long, text string")
    found = decontam.find_leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found if r.doc_id is not None}
    assert got <= truth and len(got) >= 0.97 * len(truth) and (None, 0) in {(r.doc_id, r.item_id) for r in found}
    for r in found:
        if r.doc_id is not None:
            assert r.distance == least_edits(dict(items)[r.item_id], words[r.doc_id])
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_with_all_edits_allowed_at_any_length(spark):
    rng = random.Random(18)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([15, 29, 40, 60, 120, 250, 500] * 12)]
    rows = []
    for k, own in items:
        own = list(own)
        for p in sorted(rng.sample(range(len(own)), len(own) // 5), reverse=True):
            own[p:p + 1] = [[rng.choice(vocab)], [own[p], rng.choice(vocab)], []][rng.randrange(3)]
        rows.append((k, [*text(rng.randint(0, 40)), *own, *text(rng.randint(0, 40))]))
    want = {(d, d): least_edits(items[d][1], own) for d, own in rows}
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(docs, bench).collect()}
    assert all(want[x] == far for x, far in got.items())
    assert {k for k, own in items if len(own) >= 60} <= {d for d, _ in got} and len(got) >= 0.97 * len(want)


def test_leaks_where_no_number_of_walks_is_enough(spark):
    docs = spark.createDataFrame([(0, "x x a b y y"), (1, "x a x c y"), (2, "x b y")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c")], "item_id long, text string")
    assert decontam.walks_needed(3, 1, 4) is None
    got = {(r.doc_id, r.distance) for r in decontam.find_leaks(docs, bench, percent=60).collect()}
    assert got == {(0, 1), (1, 1)}


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(sf + "/documents.parquet")
    kept = cp.quality_rules(spark, docs, sf)
    assert kept.columns == cp.COLUMNS
    good = {r.doc_id for r in queries.QUERIES["op6_quality_rules"](spark, sf).collect() if r.kept}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == good
    first = components({i: shingles(t) for i, t in texts.items()})
    unique = cp.near_copies(spark, kept, sf)
    ids = {r.doc_id for r in unique.collect()}
    assert ids == {i for i, c in first.items() if i == c} and unique.columns == cp.COLUMNS
    clean = cp.benchmark_passages(spark, unique, sf)
    items = [[w.decode() for w in decontam.words(r.text)] for r in spark.read.parquet(sf + "/benchmark.parquet").collect()]
    leaked = {i for i in ids if any(" ".join(x) in " ".join(w.decode() for w in decontam.words(texts[i])) for x in items)}
    assert {r.doc_id for r in clean.collect()} == ids - leaked
    safe = cp.personal_data(spark, clean, sf)
    assert {r.doc_id for r in safe.collect()} == ids - leaked and not safe.where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count()
    pieces = cp.packed(spark, safe, sf)
    assert {r.doc_id for r in pieces.collect()} == ids - leaked
    assert cp.run(spark, sf).count() == pieces.count()
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_copies", "benchmark_passages", "personal_data", "packing"]


def test_stages_with_repeated_and_null_ids(spark, tmp_dir):
    import corpus_pipeline as cp
    rng = random.Random(21)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e, item = (text() for _ in range(6))
    leak = f"{text()} {item} {text()}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(3)
    rows = [(1, a), (1, b), (1, a), (2, b), (2, c), (3, a + " more"), (None, d), (None, d), (None, c), (None, e + " x"), (None, ""), (None, ""), (4, None)]
    got = sorted((r.doc_id or 0, r.text or "") for r in cp.near_copies(spark, frame(rows), tmp_dir).collect())
    last = [x for x in got if x[1] == e + " x"]
    assert got == sorted([(1, a), (1, b), (2, c), (0, d), *last, (0, ""), (0, ""), (4, "")]) and len(last) == 1
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    rows = [(None, leak), (None, a), (7, leak), (7, b), (8, None)]
    got = {(r.doc_id, r.text) for r in cp.benchmark_passages(spark, frame(rows), tmp_dir).collect()}
    assert got == {(None, a), (7, b), (8, None)}


def test_near_copies_leave_no_index(spark, monkeypatch):
    import corpus_pipeline as cp
    made, write = [], common.written
    monkeypatch.setattr(jaccard, "written", lambda df, tag: made.append((tag, write(df, tag))) or made[-1][1])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(near_copies())],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = cp.near_copies(spark, docs, "")
    tables = {tag: df for tag, df in made}
    assert kept.count() and "indexed" in tables
    with pytest.raises(Exception):
        spark.read.parquet(tables["indexed"].written_to).count()


def test_oracles_hold(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        columns = [c[0] for c in cur.description]
        want = sorted(map(repr, (tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall())))
        assert sorted(columns) == sorted(df.columns) and sorted(map(repr, map(tuple, df.collect()))) == want
