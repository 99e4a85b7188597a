"""Benchmark passages in documents, verbatim or with some words changed.

Edit distance between word sequences is turned into Hamming distance by the
random walk of Chakraborty, Goldenberg and Koucky: a pointer steps on or stays
by a random bit of the word it reads, and what it reads at each step is the
embedding. Samples of a few steps are hash keys. As walks drift apart with each
edit, items are embedded in pieces of 15 to 29 words: of a passage within the
distance, one piece at least has no more than its share of the edits. Each
length of piece gets the walks that find it with its share of edits at the
wanted recall. Where a piece's key is that of a window, the whole item is
compared by exact edit distance. Windows with too few of the items' words or
word pairs to hold a piece are not embedded; that loses nothing, as an edit
spoils one word and two pairs at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items sent to the tasks at a time: further ones go in further passes over the documents.
MAX_ITEMS, MAX_ITEM_BYTES = 20_000, 32 << 20
#: Words of a piece (up to twice as many less one), keys of a walk, and steps of a key; a piece's steps fit a word's 64 bits.
PIECE, SAMPLES, SAMPLE_STEPS = 15, 8, 4
#: Share of pieces with all edits allowed that the walks find in trials; lengths that need more walks are compared at every window.
RECALL, MAX_WALKS, TRIALS = 0.99, 32, 1000
COLUMNS = "doc_id long, item_id long, distance long, item_words long, start_word long"
U = np.uint64
_NAMES = [x.split()[0] for x in COLUMNS.split(", ")]
_KEEP = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII characters other than letters and digits part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


def edits_allowed(n_words: int, percent: int) -> int:
    """Word edits that leave ``percent`` of an item's words."""
    return n_words * (100 - percent) // 100


def pieces(n_words: int) -> list[tuple[int, int]]:
    """Starts and ends of an item's pieces."""
    n = max(1, n_words // PIECE)
    return [(n_words * i // n, n_words * (i + 1) // n) for i in range(n)]


def nearest(item: list[int], part: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of ``part``, and where the first such stretch ends (bit-parallel)."""
    n, where = len(item), {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, far, best, end = full, 0, n, n, 0
    for j, w in enumerate(part):
        eq = where.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | ~(d | plus) & full, plus & d
        far += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & full, (down << 1) & full  # a stretch may begin anywhere
        plus, minus = down | ~(d | up) & full, up & d
        if far < best:
            best, end = far, j + 1
    return best, end


def _walk_bits(walk: int, n_words: int) -> np.ndarray:
    """64 random bits of each word id for a walk: bit t says if it steps on from that word in step t."""
    x = (np.arange(n_words, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U((walk + 1) * 0xD1B54A32D192ED03 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U(shift))) * U(by)
    return x ^ (x >> U(31))


def _picks(walk: int, steps: int) -> list[np.ndarray]:
    rng = np.random.default_rng([walk, steps])
    return [np.sort(rng.permutation(steps)[:SAMPLE_STEPS]) for _ in range(SAMPLES)]


def _keys(ids: np.ndarray, starts: np.ndarray, bits: np.ndarray, steps: int, picks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Keys of the windows at ``starts`` for each sample of a walk, in a fixed order."""
    at, read = starts.copy(), np.empty((steps, len(starts)), np.uint32)
    for t in range(steps):
        read[t] = ids[at]
        at += ((bits[read[t]] >> U(t)) & U(1)).astype(at.dtype)
    for sample in picks:
        key = np.zeros(len(starts), U)
        for t in sample:
            key = (key ^ (key >> U(31))) * U(0x9E3779B97F4A7C15) + read[t]
        yield key


@lru_cache(maxsize=None)
def walks_needed(n: int, edits: int, steps: int) -> int | None:
    """Walks that find ``RECALL`` of random pieces of ``n`` words with ``edits`` random edits; None if ``MAX_WALKS`` do not."""
    rng, vocabulary = np.random.default_rng([n, edits, steps]), 20_000
    word = lambda *size: rng.integers(1, vocabulary, size).astype(np.uint32)
    width = n + 3 * edits + steps + 1
    items, docs = np.zeros((TRIALS, n + steps + 1), np.uint32), word(TRIALS, width)
    items[:, :n] = word(TRIALS, n)
    for item, doc in zip(items, docs):
        own = item[:n].tolist()
        for p in sorted(rng.permutation(n)[:edits].tolist(), reverse=True):
            new = word(1).tolist()
            own[p:p + 1] = (new, [own[p], *new], [])[rng.integers(3)]
        doc[edits:edits + len(own)] = own
    own_starts = np.arange(TRIALS) * items.shape[1]
    starts = (np.arange(TRIALS)[:, None] * width + np.arange(2 * edits + 1)).ravel()
    found = np.zeros(TRIALS, bool)
    for walk in range(MAX_WALKS):
        bits, picks = _walk_bits(walk, vocabulary), _picks(walk, steps)
        for a, b in zip(_keys(items.ravel(), own_starts, bits, steps, picks), _keys(docs.ravel(), starts, bits, steps, picks)):
            found |= (b.reshape(TRIALS, -1) == a[:, None]).any(1)
        if found.mean() >= RECALL:
            return walk + 1
    return None


class Finder:
    """The items of a pass, their vocabulary and their pieces' keys, by classes of similar length."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.percent = [], percent
        for item, text in items:
            if own := words(text):
                self.items.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]))
        self.lookup = {w: np.uint32(i).tobytes() for w, i in self.vocabulary.items()}
        self.pairs = np.zeros(1 << 24, bool)  # marks the items' word pairs; a wrong mark only embeds a window more
        by_class: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, own) in enumerate(self.items):
            self.pairs[self._pair(np.array(own[:-1], np.uint32), np.array(own[1:], np.uint32))] = True
            for lo, hi in pieces(len(own)):
                by_class.setdefault(int(np.log(hi - lo) / np.log(1.25)), []).append((k, lo, hi))
        self.classes, self.margin = [], 2
        self.bits: list[np.ndarray] = []
        for members in by_class.values():
            sizes = {hi - lo for _, lo, hi in members}
            least = min(n - edits_allowed(n, percent) for n in sizes)
            pairs = min(n - 1 - 2 * edits_allowed(n, percent) for n in sizes)
            span = max(n + edits_allowed(n, percent) for n in sizes)
            steps = max(1, min(sizes) * 8 // 5)
            needed = [walks_needed(n, edits_allowed(n, percent), steps) for n in sizes]
            walks = None if None in needed else max(needed)
            whose = np.array([(k, lo) for k, lo, _ in members])
            tables = []
            if walks is not None:
                own = np.zeros((len(members), max(sizes) + steps + 1), np.uint32)
                for row, (k, lo, hi) in zip(own, members):
                    row[: hi - lo] = self.items[k][1][lo:hi]
                while len(self.bits) < walks:
                    self.bits.append(_walk_bits(len(self.bits), len(self.vocabulary) + 1))
                for walk in range(walks):
                    for keys in _keys(own.ravel(), np.arange(len(members)) * own.shape[1], self.bits[walk], steps, _picks(walk, steps)):
                        order = np.argsort(keys, kind="stable")
                        tables.append((keys[order], whose[order]))
            self.classes.append((least, pairs, span, steps, walks, whose, tables))
            self.margin = max(self.margin, span + steps + 1)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(8)

    def find(self, docs: list[tuple[int | None, str | None]]) -> list[tuple]:
        """Rows (document, item, distance, item's words, start) of a batch; the best place per document and item."""
        if not self.items:
            return []
        get, none = self.lookup.get, b"\0\0\0\0"
        gap = np.zeros(self.margin, np.uint32)
        parts, sizes = [], []
        for _, text in docs:
            own = np.frombuffer(b"".join([get(w, none) for w in words(text)]), np.uint32)
            parts += [own, gap]
            sizes.append(len(own))
        ids = np.concatenate([*parts, gap])
        first = np.cumsum([0, *[n + self.margin for n in sizes]])
        known = ids > 0
        count = np.concatenate([[0], np.cumsum(known)])
        paired = np.concatenate([[0], np.cumsum(self.pairs[self._pair(ids[:-1], ids[1:])] & known[:-1] & known[1:])])
        n = len(ids) - self.margin
        spots = np.flatnonzero(known[:n])
        near: dict[tuple[int, int], set[int]] = {}
        for least, pairs, span, steps, walks, whose, tables in self.classes:
            starts = spots[(count[spots + span] - count[spots] >= least) & (paired[spots + span - 1] - paired[spots] >= pairs)]
            if not len(starts):
                continue
            docs_of = np.searchsorted(first, starts, "right") - 1
            if walks is None:
                for doc, start in zip(docs_of.tolist(), (starts - first[docs_of]).tolist()):
                    for k, lo in whose.tolist():
                        near.setdefault((doc, k), set()).add(start - lo)
                continue
            own = (x for w in range(walks) for x in _keys(ids, starts, self.bits[w], steps, _picks(w, steps)))
            for (keys, members), keyed in zip(tables, own):
                lo, hi = np.searchsorted(keys, keyed), np.searchsorted(keys, keyed, "right")
                for i in np.flatnonzero(hi > lo):
                    doc = int(docs_of[i])
                    for k, at in members[lo[i]:hi[i]].tolist():
                        near.setdefault((doc, k), set()).add(int(starts[i] - first[doc]) - at)
        out = []
        for (doc, k), places in sorted(near.items()):
            item, own = self.items[k]
            allowed, best = edits_allowed(len(own), self.percent), None
            reach, places = len(own) + 2 * allowed, sorted(places)
            text, at = ids[first[doc]:first[doc] + sizes[doc]], 0
            while at < len(places):  # places near each other are one stretch
                lo = max(0, places[at] - reach)
                hi = places[at] + reach
                while at < len(places) and places[at] <= hi:
                    hi = min(max(hi, places[at] + reach), lo + 8 * reach)
                    at += 1
                far, end = nearest(own, text[lo:hi + reach].tolist())
                if far <= allowed and (best is None or far < best[0]):
                    best = far, max(0, lo + end - len(own))
            if best:
                out.append((docs[doc][0], item, best[0], len(own), best[1]))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: the least word edit distance and about where.

    An item is in a document if some stretch of it is within ``100 - percent``
    percent of the item's words of edits. Items without a word, or with a null
    text, are in none; nor is anything in a null or empty text. Ids may be null;
    rows of a repeated id, or repeated items, yield rows each. Items are sent to
    the tasks in bounded blocks, one pass over the documents each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    out, block, size = None, [], 0

    def one_pass(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            finder = Finder(sent.value, percent)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                lo = 0
                while lo < len(ids):  # about 4 MB of text at a time
                    hi, n = lo, 0
                    while hi < len(ids) and n < 4_000_000:
                        n += len(texts[hi])
                        hi += 1
                    found = finder.find(list(zip(ids[lo:hi], texts[lo:hi])))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=_NAMES)
                    lo = hi

        return rows.mapInArrow(run, COLUMNS)

    for r in items.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).where(
            F.col(item_text_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= MAX_ITEMS or size >= MAX_ITEM_BYTES:
            out = one_pass(block) if out is None else out.unionAll(one_pass(block))
            block, size = [], 0
    if block or out is None:
        out = one_pass(block) if out is None else out.unionAll(one_pass(block))
    return out
