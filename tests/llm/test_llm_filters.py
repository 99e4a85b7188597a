"""URL filter, language identification, quality rules, personal data."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqframe.llm import langid, pii, quality, queries, url_filter

PARTS = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")


def test_urls_against_brute_force(spark):
    urls = [None, "", "nourl", "http://A.Example.NET/en/x?utm_source=a", "https://example.net/fr/", "https://notexample.net/en/", "x://b.org/fr/1",
            "https://b.org/de", "https://www.C.com/p/?b=2&a=1&ref=z#top", "http://c.com/p?a=1&b=2", "a://b://c/d", "http://d.example.com/de/", "net://net"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[-4:])] + [(None, "http://c.com/p?a=1&b=2", "x")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://C.com/p?b=2&a=1",), (None,), ("https://C.com/p?b=2&a=1",)], "url string")
    rows = url_filter.filter_urls(pages, listed, queries.URL_RULES).collect()
    assert len(rows) == pages.count()
    by_id = {r.page_id: r for r in rows}
    for i, u in enumerate(urls):
        m = PARTS.match(u or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fit = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
        blocked = u in (urls[8], urls[9])
        r = by_id[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if blocked else "allow")), u
    assert by_id[None].verdict == "block"
    empty = url_filter.filter_urls(pages, listed.limit(0), queries.URL_RULES)
    assert {r.listed for r in empty.collect()} == {False} and url_filter.filter_urls(pages.limit(0), listed, []).count() == 0


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks, n = url_filter.bloom_blocks(keys, "k", 3000)
    assert blocks.count() <= n <= url_filter.MAX_BLOCKS
    probe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    found = url_filter.may_contain(probe, "k", blocks, n, "maybe").where("maybe")
    assert found.where("id < 3000").count() == 3000 and found.where("id >= 3000").count() < 400


def brute_rank(text, profiles, size):
    counts = Counter(g for w in langid.WORD.findall((text or "").lower()) for g in langid.grams(w))
    top = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    far = {lang: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(top)) for lang, p in profiles.items()}
    return min(far, key=lambda x: (far[x], x)) if top else "und"


def test_language_profiles_and_ranks(spark):
    words = {"en": "the of and that with this from", "de": "der die und nicht ein schön über", "fr": "le la été où déjà une"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(20)), x) for i, x in enumerate(list(words) * 20)]
    train = spark.createDataFrame(rows + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    profiles = {}
    for r in langid.language_profiles(train, 50).collect():
        profiles.setdefault(r.lang, {})[r.gram] = r["rank"]
    counts = Counter(g for _, t, x in rows if x == "de" for w in langid.WORD.findall(t.lower()) for g in langid.grams(w))
    assert profiles["de"] == {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:50])}
    docs = spark.createDataFrame([(1, "und nicht über"), (2, None), (3, " 12 !"), (4, "the " * 5000), (None, "été"), (1, "la")], "doc_id long, text string")
    got = langid.identify_languages(docs, langid.language_profiles(train, 50), 50).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter((r.doc_id, brute_rank(r.text, profiles, 50)) for r in docs.collect())
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (2, 3)} == {"und"}
    none = langid.identify_languages(docs, langid.language_profiles(train.limit(0), 50), 50)
    assert {r.lang_pred for r in none.collect()} == {"und"}


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    covered = {i + k for i, g in enumerate(tri) if c[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_weights(spark):
    rng = random.Random(3)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(90)) + "." for _ in range(60)]
    bad = ["A$$$ reha*** ontion&&& inre### of%%% " * 20 + str(i) for i in range(6)]
    odd = [None, "", " \n ", "a b", "a b c a b c", "x\ny\nx\n\n \nx", "\x1c a\x0bb\x0cc", "é ñ " * 100, "A B C D " * 5000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(good + bad + odd)] + [(None, good[0], "c"), (0, good[0], "c")], "doc_id long, text string, quality string")
    rows = quality.judge_quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        q, want = r.quality, brute_measures(r.text or "")
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (q.base_failed and q.kept)
    assert all(r.quality.kept for r in rows if r.text in good) and not any(r.quality.kept for r in rows if r.text in bad)
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_em_equals_a_plain_loop(spark):
    votes = [((1, 1, None), 40), ((1, 0, 1), 5), ((0, 0, 1), 7), ((None, None, None), 3), ((0, 0, 0), 6)]
    names = ["a", "b", "c"]
    df = spark.createDataFrame([v for v, n in votes for _ in range(n)], "a int, b int, c int")
    got = quality.fit_rules(df, names, 5)
    p, g, b = quality.GOOD, [quality.KEEPS] * 3, [quality.REJECTS] * 3
    for _ in range(5):
        q = []
        for v, _n in votes:
            o = math.log(p / (1 - p)) + sum(math.log(g[j] / (1 - b[j])) if x == 1 else math.log((1 - g[j]) / b[j]) for j, x in enumerate(v) if x is not None)
            q.append(1 / (1 + math.exp(-o)))
        share = lambda j, vote, w, first: (sum(n * w(x) for (v, n), x in zip(votes, q) if v[j] == vote) + first * quality.WEIGHT) / (
            sum(n * w(x) for (v, n), x in zip(votes, q) if v[j] is not None) + quality.WEIGHT)
        p = (sum(n * x for (_, n), x in zip(votes, q)) + quality.GOOD * quality.WEIGHT) / (sum(n for _, n in votes) + quality.WEIGHT)
        g, b = [share(j, 1, lambda x: x, quality.KEEPS) for j in range(3)], [share(j, 0, lambda x: 1 - x, quality.REJECTS) for j in range(3)]
    assert got["good"] == pytest.approx(p) and [got[f"good_{x}"] for x in names] == pytest.approx(g) and [got[f"bad_{x}"] for x in names] == pytest.approx(b)


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


PII_TEXTS = ["a@b.c_d@e.f", "x" * 20000 + "@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1111 5",
             "+1 (988) 555-2485. +12345678 ", "é@a.b ñ+49 30 123456", "1 " * 5000, "a@b.c" * 300, None, "", "+1" + " " * 3000 + "2", "a.b@c-d.e-f..g@h.i",
             "@@a@b@c.d.", "12345678901234567890 4111111111111111", "🎉 a@b.de 🎉 10.0.0.1"]


def test_personal_data_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(PII_TEXTS)] + [(None, "q@r.st", "c"), (0, "a@b.c_d@e.f", "c")], "doc_id long, text string, pii string")
    rows = pii.find_personal_data(docs).withColumn("clean", pii.sanitised(F.coalesce("text", F.lit("")), F.col("pii"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = [(pii.KINDS[x.kind], x.s, x.e) for x in r.pii if x.kind < 4]
        assert got == base_spans(r.text or ""), r.text
    clean = {r.text: r.clean for r in rows}
    assert clean["🎉 a@b.de 🎉 10.0.0.1"] == "🎉 [EMAIL] 🎉 [IP]" and clean[""] == "" == clean[None]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_disclosing_terms_are_found_near_their_entity(spark):
    rng = random.Random(4)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    rows = [f"{filler()} write Zebulon at zeb@corp.io please {filler()}" for _ in range(6)] + [f"{filler()} write at all please {filler()}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = pii.find_personal_data(docs).withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).collect()
    for r in out:
        terms = [r.text[x.s:x.e] for x in r.pii if x.kind == 4]
        assert terms == (["Zebulon"] if r.doc_id < 6 else [])  # "write" and "please" stand everywhere, fillers once
        assert "Zebulon" not in r.clean and ("[EMAIL]" in r.clean) == (r.doc_id < 6)
    few = spark.createDataFrame([(i, rows[0]) for i in range(50)], "doc_id long, text string")
    assert all(x.kind < 4 for r in pii.find_personal_data(few).collect() for x in r.pii)  # copies of one text prove nothing


def test_disclosing_terms_are_replaced_in_every_text(spark):
    rng = random.Random(14)
    filler = lambda n=40: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    near = [f"{filler()} Zebulon zeb@corp.io {filler()} zebulon. {filler()}" for _ in range(6)]
    far = [f"{filler()} Quillon {filler()} q.@corp.io 10.0.0.{i} {filler()}" for i in range(6)]
    alone = [f"{filler()} ZEBULON, é🎉Zebulons {filler()}", f"zebulon@x.de {filler()}"]
    others = [f"{filler(8)} write at all please {filler(8)}" for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(near + far + alone + others), (None, alone[0]), (900, None)], "doc_id long, text string").repartition(3)
    out = pii.find_personal_data(docs).withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).collect()
    want = {**{t: ["Zebulon", "zebulon"] for t in near}, **{t: ["Quillon"] for t in far}, alone[0]: ["ZEBULON"]}
    assert len(out) == docs.count()
    for r in out:
        assert [r.text[x.s:x.e] for x in r.pii if x.kind == 4] == want.get(r.text, []), r.text
        assert r.text is None or not re.search(r"(?i)\b(zebulon|quillon)\b", r.clean)
    rows = pii.find_personal_data(docs, keep_text=False)
    assert rows.columns == ["doc_id", "pii"] and sum(x.kind == 4 for r in rows.collect() for x in r.pii) == 12 + 6 + 2


def test_digest_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op5_personal_data"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    for r in rows:
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS[:4]]


def test_very_many_matches_in_one_text(spark):
    n = 200_000
    text = "é" + "".join(f" u{i}@b.cd Zebulon," for i in range(n))
    docs = spark.createDataFrame([(1, text)] + [(i, f"Zebulon x{i}@b.cd u1@b.cd") for i in range(2, 6)] + [(i, "write at all") for i in range(6, 90)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).where("doc_id < 3").collect()}
    spans = rows[1].pii
    assert [(x.s, x.e) for x in spans if x.kind == 0] == [m.span() for m in re.finditer(r"u[0-9]+@b\.cd", text)]
    assert [(x.s, x.e) for x in spans if x.kind == 4] == [m.span() for m in re.finditer("Zebulon", text)]
    assert rows[1].clean == "é" + " [EMAIL] ," * n


def test_overlapping_spans_are_replaced_once(spark):
    spans = [(0, 0, 3, "A"), (0, 2, 9, "B"), (0, 5, 6, "C"), (0, 9, 10, "D"), (0, 12, 14, "E")]
    rows = spark.createDataFrame([("🎉bcdefghijklmnop", spans), ("abc", []), ("", [])], "text string, p array<struct<kind:int,s:int,e:int,tag:string>>")
    assert [r[0] for r in rows.select(pii.sanitised(F.col("text"), F.col("p"))).collect()] == ["ADklEop", "abc", ""]


def test_disclosure_equals_a_plain_count(spark):
    rng = random.Random(21)
    words = ["alder", "birch", "cedar", "damson", "elder", "foxglove"]
    texts = []
    for i in range(240):
        some = [w for k, w in enumerate(words) if rng.random() < (k + 1) / 9]
        mail = [f"m{k}@corp.io" for k in range(3) if rng.random() < 0.1 * (k + 1)]
        if "m0@corp.io" in mail:
            some.append("zebulon")
        texts.append(" ".join([*some, *mail, f"id{i}"]))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("__base", pii.base_spans(F.col("text"))).withColumn("__digest", F.sha2("text", 256))
    got = {(r.entity, r.term): (r.disclosure, r.removed) for r in pii.disclosing_terms(docs, pii.terms_of(F.col("text"), F.col("__base")), 3, 0.05, 0.5).collect()}
    want = {}
    for m in ("m0@corp.io", "m1@corp.io", "m2@corp.io"):
        holds = [t for t in texts if m in t]
        for w in [*words, "zebulon"]:
            both, n_t = sum(w in t for t in holds), sum(w in t for t in texts)
            if both >= 3 and (d := math.log2(both * len(texts) / (len(holds) * n_t)) / math.log2(len(texts) / len(holds))) >= 0.05:
                want["0:" + m, w] = (d, d >= 0.5)
    assert ("0:m0@corp.io", "zebulon") in want and got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1]
