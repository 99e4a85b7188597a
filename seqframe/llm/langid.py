"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order. A document's
own most frequent n-grams are compared with each profile by the out-of-place
distance; the nearest language wins.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Languages at most, checked: with ``size`` n-grams each they bound what is sent to the tasks.
MAX_LANGUAGES = 1000
_MAX_WORDS, _MAX_GRAMS = 300_000, 200_000


def grams(word: str, longest: int = 3) -> list[str]:
    """N-grams of 1 to ``longest`` letters of the word between blanks (written _)."""
    w = f"_{word}_"
    return [g for n in range(1, longest + 1) for i in range(len(w) - n + 1) if (g := w[i:i + n]) != "_"]


def language_profiles(texts: DataFrame, size: int = 400, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, rank): the ``size`` most frequent n-grams of each language over all its texts, ties by n-gram.

    Rows with a null language or text teach nothing. Counts are summed in each
    task first, so a language with most of the rows is no hot group.
    """

    def run(batches):
        counts: dict[str, Counter] = {}

        def drain():
            for lang, words in counts.items():
                own: Counter = Counter()
                for word, n in words.items():
                    for g in grams(word):
                        own[g] += n
                for at in range(0, len(own), 50_000):
                    part = list(own.items())[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([g for g, _ in part]),
                                                      pa.array([n for _, n in part], pa.int64())], names=["lang", "gram", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, counts.values())) > _MAX_WORDS:
                yield from drain()
        yield from drain()

    rows = texts.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return sums.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


class Ranker:
    """Out-of-place distances of texts to the profiles."""

    def __init__(self, profiles: dict[str, dict[str, int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.profiles = [profiles[x] for x in self.langs]
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, bytes] = {}
        self.ids: dict[str, int] = {}
        self.code = np.zeros(1 << 12, np.int64)  # an n-gram's characters as a number: its order among ties
        self.rank = np.full((len(self.langs), 1 << 12), self.size, np.int32)

    def _learn(self, word: str) -> bytes:
        out = []
        for g in grams(word):
            i = self.ids.get(g)
            if i is None:
                i = self.ids[g] = len(self.ids)
                if i == len(self.code):
                    self.code = np.concatenate([self.code, np.zeros_like(self.code)])
                    self.rank = np.concatenate([self.rank, np.full_like(self.rank, self.size)], axis=1)
                self.code[i] = sum(ord(c) << (42 - 21 * k) for k, c in enumerate(g))
                for k, p in enumerate(self.profiles):
                    self.rank[k, i] = p.get(g, self.size)
            out.append(i)
        self.words[word] = x = np.array(out, np.uint32).tobytes()
        return x

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and 1 less the share of the largest possible distance; ``und`` and 0 without a letter or a profile."""
        words = WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.words) > _MAX_WORDS or len(self.ids) > _MAX_GRAMS:
            self._clear()
        known = self.words
        ids = np.frombuffer(b"".join([known.get(w) or self._learn(w) for w in words]), np.uint32)
        counts = np.bincount(ids)
        own = np.flatnonzero(counts)
        own = own[np.lexsort((self.code[own], -counts[own]))][: self.size]
        ranks = self.rank[:, own]
        far = np.where(ranks < self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)), self.size).sum(1)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.size * len(own))


def identify_languages(docs: DataFrame, profiles: DataFrame, size: int = 400,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone.

    A null text, or one without a letter, gets ``und`` and 0. With no profile
    at all every row does. Equal distances go to the language first by name.
    Ids may be null or repeated; other columns are ignored.
    """
    found = profiles.collect()  # at most MAX_LANGUAGES * size rows
    by_lang: dict[str, dict[str, int]] = {}
    for r in found:
        by_lang.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"{len(by_lang)} languages; at most {MAX_LANGUAGES} profiles are sent to the tasks")
    sent = docs.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches):
        ranker = Ranker(sent.value, size)
        for batch in batches:
            out = [ranker.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()),
                                              pa.array([x for _, x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
