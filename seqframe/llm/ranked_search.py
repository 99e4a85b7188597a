"""Ranked lexical search with hashed max-sketches.

A document's sketch has one cell for each hash value of a term and keeps the
largest impact (the part of a term's score that depends on the document) among
the terms of that value. A query's weights, looked up in the sketch, give an
upper bound of the document's score. Documents are scored exactly in falling
order of their bounds, until the bounds fall below the last score kept.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.llm.words import words_of

CELLS = 4096
#: Items and bytes of their texts that one pass over the documents takes at most; they bound what is sent to the tasks.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 8 << 20
#: Documents, and bytes of their texts, whose sketches are looked up together.
BATCH_DOCS, BATCH_BYTES = 256, 4 << 20
_MAX_WORDS = 400_000
_NO_ID = -(1 << 63)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf, length: int):
    """The document's part of a term's score; ``length`` is ``length_factor``'s."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * length)


def length_factor(n: int, n_docs: int, total: int) -> int:
    return 100 - 25 + (25 * n * n_docs) // total


def corpus_statistics(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and how many documents hold each term of ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, own, n, total = sent.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                n += bool(words)
                total += len(words)
                own.update(known.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array([None, *own], pa.binary()), pa.array([n, *own.values()], pa.int64()),
                                          pa.array([total] + [0] * len(own), pa.int64())], names=["term", "docs", "terms"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term binary, docs long, terms long")
    n, total, df = 0, 0, {}
    for r in found.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect():
        if r["term"] is None:
            n, total = r["docs"], r["terms"]
        else:
            df[bytes(r["term"])] = r["docs"]
    return n, total, df


class _Cells(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MAX_WORDS:
            self.clear()
        c = self[word] = zlib.crc32(word) % CELLS
        return c


class Searcher:
    """The best ``k`` documents of each item among those given, by descending bounds and exact scores."""

    def __init__(self, items: list[list[tuple[bytes, int]]], n_docs: int, total: int, k: int):
        self.items, self.n_docs, self.total, self.k = items, n_docs, total, k
        self.cells = _Cells()
        self.lookup = np.zeros((CELLS, len(items)))
        for i, terms in enumerate(items):
            for term, w in terms:
                self.lookup[self.cells[term], i] += w
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]  # heaps of (score, -id): the worst first

    def sketch(self, counts: Counter, length: int) -> np.ndarray:
        """The largest impact in each cell."""
        out = np.zeros(CELLS, np.int64)
        cells = np.fromiter(map(self.cells.__getitem__, counts), np.int64, len(counts))
        np.maximum.at(out, cells, impact(np.fromiter(counts.values(), np.int64, len(counts)), length))
        return out

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds (documents x items); the margin covers the rounding of sums beyond 2 ** 53."""
        return sketches.astype(np.float64) @ self.lookup * (1 + 1e-9)

    def score(self, item: int, counts: Counter, length: int) -> int:
        return sum(w * impact(tf, length) for term, w in self.items[item] if (tf := counts.get(term)))

    def add(self, docs: list[tuple[int | None, Counter, int]]) -> None:
        """Take a batch of (id, term counts, number of terms)."""
        docs = [(_NO_ID if i is None else -i, c, length_factor(n, self.n_docs, self.total)) for i, c, n in docs if n]
        if not docs or not self.items:
            return
        bounds = self.bounds(np.stack([self.sketch(c, m) for _, c, m in docs]))
        least = np.array([h[0][0] if len(h) == self.k else 1 for h in self.best], np.float64)
        for item in np.flatnonzero((bounds >= least).any(0)).tolist():
            bound, heap = bounds[:, item], self.best[item]
            own = np.flatnonzero(bound >= least[item])
            for d in own[np.argsort(-bound[own], kind="stable")].tolist():
                if len(heap) == self.k and bound[d] < heap[0][0]:
                    break
                entry = (self.score(item, docs[d][1], docs[d][2]), docs[d][0])
                if entry[0] > 0:
                    if len(heap) < self.k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)


def _blocks(items: DataFrame, item_col: str, text_col: str):
    held, size = [], 0
    for at, r in enumerate(items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator()):
        text = r[1] or ""
        if held and (len(held) == BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((at, r[0], text))
        size += len(text)
    if held:
        yield held


def _search_block(docs: DataFrame, block: list[tuple[int, int | None, str]], k: int, id_col: str, text_col: str) -> DataFrame:
    terms = [Counter(words_of(text)) for _, _, text in block]
    n_docs, total, df = corpus_statistics(docs, set().union(*terms), text_col)
    weights = {t: weight(n_docs, x) for t, x in df.items()}  # a term that no document holds adds nothing
    weighted = [[(t, c * weights[t]) for t, c in own.items() if weights.get(t)] for own in terms]
    sent = docs.sparkSession.sparkContext.broadcast((weighted, n_docs, total, k))
    names = [(at, item) for at, item, _ in block]

    def run(batches):
        searcher, held, size = Searcher(*sent.value), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = words_of(text)
                held.append((doc, Counter(words), len(words)))
                size += len(text or "")
                if len(held) == BATCH_DOCS or size > BATCH_BYTES:
                    searcher.add(held)
                    held, size = [], 0
        searcher.add(held)
        out = [(at, item, None if doc == _NO_ID else -doc, score) for (at, item), heap in zip(names, searcher.best) for score, doc in heap]
        part = TaskContext.get().partitionId() % 256
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                          pa.array(cols[3], pa.int64()), pa.array([part] * len(out), pa.int32())],
                                         names=["at", "item_id", "doc_id", "score", "part"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "at long, item_id long, doc_id long, score long, part int")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents with a score above 0.

    Equal scores go to the smaller doc_id, a null one last; repeated ids are
    documents of their own, in no set order among equals. A null text, or one without a term, is in no
    result and counts for nothing; an item without a term, or whose terms no
    document holds, has no row. Each row of ``items`` is an item, also where
    ids are null or repeated. Items go to the tasks in blocks of at most
    ``BLOCK_ITEMS``, two passes over the documents each. A task returns at most k rows an
    item, and those are cut to k in 256 groups first, so the last window holds
    at most 256 k rows of an item at any number of tasks.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = None
    for block in _blocks(items, item_col, item_text_col):
        own = _search_block(docs, block, k, id_col, text_col)
        found = own if found is None else found.unionAll(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first = found.withColumn("rank", F.row_number().over(W.partitionBy("at", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB text of ``search`` with k = 20 over ``documents`` and ``benchmark``.
ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
stats AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
i AS (SELECT row_number() OVER () AS q, item_id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
query AS (SELECT q, item_id, term, count(*) AS times FROM i GROUP BY q, item_id, term),
w AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM query) GROUP BY r, doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, stats),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM query JOIN weights USING (term) JOIN tf USING (term), stats GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
