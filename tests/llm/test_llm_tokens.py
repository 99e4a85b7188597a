"""Tokens: ids as the library gives them, cache, packing, files."""

import os
import random
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import packing, token_cache, token_files, tokenize

NAME = "byte_bpe_50k.json"
ODD = [None, "", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "The end.\nNext, one!\n", "don't I'll 's", "é ñ ß,", "日本 語", "x\x1cy",
       "<|endoftext|> in <|endoftext|>", "a\tb", "²½ 12 3.4", "z" * 5000, "word " * 4000]


def library(texts, name=NAME):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenize.tokenizer_path(name))
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def docs(spark):
    rows = [(i, x, "clash") for i, x in enumerate(ODD)] + [(None, "no id", "c"), (3, "again id 3", "c"), (3, "again id 3", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_ids_equal_the_library():
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", ".", ",", "'s", "1", "é", "ñ", "日", "\u3000", "\x85", "<|endoftext|>", "!", "_", "\u0301", "Ā", "ª"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [x or "" for x in ODD]
    got = tokenize.encoder(NAME).ids(texts)
    assert [list(np.frombuffer(x, "<u4")) for x in got] == library(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    ids = [list(np.frombuffer(x, "<u4")) for x in tokenize.encoder(name).ids(["Some words.", ""])]
    assert len(ids[0]) > 1 and ids[1] == []


@pytest.mark.parametrize("often", [2, 1000])
def test_token_counts_cache(spark, docs, often, monkeypatch):
    monkeypatch.setattr(token_cache, "OFTEN", often)
    path = os.path.join(tempfile.mkdtemp(), "cache")
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n) for r, n in
                  zip(docs.collect(), map(len, library([r.text for r in docs.collect()]))))
    for _ in range(2):
        got = token_cache.count_tokens(docs, path, NAME).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(path)  # the second run encoded nothing
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_cache.count_tokens(docs.limit(0), path, NAME).count() == 0


@pytest.mark.parametrize("fan_in", [2, 512])
def test_packing_places_every_id_once(spark, docs, fan_in):
    rows = packing.pack_documents(docs.repartition(7), NAME, capacity=64, max_open=4, max_gap=2, fan_in=fan_in).collect()
    texts = [r for r in docs.collect()]
    full = {}
    for r, ids in zip(texts, library([r.text for r in texts])):
        full.setdefault(r.doc_id, []).append(ids + [1])
    windows, total = {}, 0
    for r in rows:
        assert any(crc(x[r.start:r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for x in full[r.doc_id])
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(len(x) for xs in full.values() for x in xs)
    for pieces in windows.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    assert len(windows) <= total / 64 * 1.1 + 2
    assert packing.pack_documents(docs.limit(0), NAME).count() == 0


def test_packer_best_fit_and_fullest():
    p = packing.Packer(10, 2, 1)
    piece = lambda n: packing.Piece(n, 0, memoryview(b"\0" * 4 * n), n)
    assert list(p.add(piece(6))) == [] and list(p.add(piece(5))) == []
    assert [[x.n for x in w] for w in p.add(piece(4))] == [[6, 4]]  # best fit closes the fuller window
    list(p.add(piece(7)))
    out = list(p.add(piece(6)))  # none fits: the fullest (7) is topped up with 3
    assert [[x.n for x in w] for w in out] == [[7, 3]]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, docs, encoding):
    import pyarrow.parquet as pq
    path = os.path.join(tempfile.mkdtemp(), "tokens")
    token_files.write_token_files(docs, path, NAME, end_id=0, encoding=encoding)
    got = token_files.token_checksums(spark, path).collect()
    assert len(got) == docs.count()
    at = 0
    by_start = sorted(got, key=lambda r: r.start)
    for r in by_start:  # gapless, in ascending id order, null first
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert ids == sorted(ids)
    want = sorted((-1 if r.doc_id is None else r.doc_id, crc(x + [0])) for r, x in zip(docs.collect(), library([r.text for r in docs.collect()])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_files.token_index(spark, path).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}
    files = [os.path.join(path, x) for x in os.listdir(path) if x.endswith(".parquet")]
    column = max((pq.ParquetFile(f).metadata.row_group(0).column(4) for f in files if pq.ParquetFile(f).metadata.num_row_groups),
                 key=lambda c: c.total_uncompressed_size)
    assert any(("DICT" in e) if encoding == "dictionary" else ("DELTA" in e) for e in column.encodings)
    some = token_files.read_token_files(spark, path, ["doc_id", "ids"], F.col("doc_id") == 7)
    assert [r.ids[-1] for r in some.collect()] == [0]
    assert "n_tokens" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
