"""Packing of documents into sequences of a fixed number of tokens.

Bounded-space online packing: a task keeps ``max_open`` open windows and places
each document's tokens in the window where they fit best. When none fits, the
fullest window is topped up by cutting the document, or closed as it is if its
gap is at most ``max_gap``. What a task leaves open is poured together, and the
last part of each task meets those of up to ``fan_in`` others, level by level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import written
from seqframe.llm.tokenize import encoded

COLUMNS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_tokens long")
_KEPT = COLUMNS + ", part long, ids binary"
_ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _KEPT.split(", ")])


class Piece:
    """Tokens ``start`` to ``start + n`` of a document, with their ids (4 bytes each)."""

    __slots__ = ("doc", "start", "ids", "total", "n")

    def __init__(self, doc, start, ids, total):
        self.doc, self.start, self.ids, self.total, self.n = doc, start, ids, total, len(ids) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc, self.start, self.ids[:4 * n], self.total),
                Piece(self.doc, self.start + n, self.ids[4 * n:], self.total))


class Packer:
    """Best-fit over a fixed number of open windows; ``add`` and ``rest`` yield closed windows (lists of pieces)."""

    def __init__(self, capacity: int, max_open: int, max_gap: int):
        self.capacity, self.max_open, self.max_gap = capacity, max_open, max_gap
        self.open: list[tuple[int, list[Piece]]] = []  # (free, pieces)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece.n >= self.capacity:
            head, piece = piece.cut(self.capacity)
            yield [head]
        while piece.n:
            fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= piece.n]
            if fits:
                free, i = min(fits)
                pieces = self.open[i][1]
                pieces.append(piece)
                if free == piece.n:
                    self.open.pop(i)
                    yield pieces
                else:
                    self.open[i] = (free - piece.n, pieces)
                return
            if len(self.open) < self.max_open:
                self.open.append((self.capacity - piece.n, [piece]))
                return
            i = min(range(len(self.open)), key=lambda k: self.open[k][0])
            free, pieces = self.open.pop(i)
            if free > self.max_gap:
                head, piece = piece.cut(free)
                pieces.append(head)
            yield pieces

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows poured together: full ones, then at most one part."""
        now, n = [], 0
        for _, pieces in sorted(self.open, key=lambda x: x[0]):
            for piece in pieces:
                while n + piece.n >= self.capacity:
                    head, piece = piece.cut(self.capacity - n)
                    yield now + [head]
                    now, n = [], 0
                if piece.n:
                    now, n = now + [piece], n + piece.n
        self.open = []
        if now:
            yield now


def _rows(windows, first_id: int, part: int, capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of closed windows; an unfilled window of the end keeps its ids, to be merged, unless this is the last level."""
    out: list[tuple] = []
    for k, (pieces, ending) in enumerate(windows):
        filled = sum(p.n for p in pieces)
        keeps = ending and not last and filled < capacity
        at = 0
        for p in pieces:
            out.append((p.doc, p.start, p.n, zlib.crc32(p.ids), p.total, first_id + k, at, filled,
                        part if keeps else -1, bytes(p.ids) if keeps else None))
            at += p.n
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 1,
                   max_open: int = 32, max_gap: int = 8, fan_in: int = 512,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence.

    A null text is an empty one, so each row yields at least the end id. Null or
    repeated ids are packed like others, each row by itself. Other columns are
    ignored; an empty table gives an empty result. Longer documents than a
    window are cut. Only each task's last, unfilled window travels on; a merge
    task holds at most ``fan_in`` of them.
    """
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(capacity, max_open, max_gap)

        def windows():
            for batch, ids in encoded(batches, 1, tokenizer):
                for doc, x in zip(batch.column(0).to_pylist(), ids):
                    whole = x + tail
                    for w in packer.add(Piece(doc, 0, memoryview(whole), len(whole) // 4)):
                        yield w, False
            for w in packer.rest():
                yield w, True

        yield from _rows(windows(), part << 32, part, capacity, False)

    pieces = written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _KEPT), "packed")
    done = [pieces.where("part < 0")]
    left = pieces.where("part >= 0")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = -(-parts // fan_in)
        merge = left.groupBy(F.floor(F.col("part") / fan_in).alias("group")).applyInArrow(
            _merger(capacity, max_open, max_gap, level, groups == 1), _KEPT)
        if groups == 1:
            done.append(merge)
            break
        merge = written(merge, "packed")
        done.append(merge.where("part < 0"))
        left, parts = merge.where("part >= 0"), groups
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.drop("part", "ids")


def _merger(capacity: int, max_open: int, max_gap: int, level: int, last: bool):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["sequence_id"], r["offset"]))
        packer = Packer(capacity, max_open, max_gap)

        def windows():
            for r in rows:
                for w in packer.add(Piece(r["doc_id"], r["start"], memoryview(r["ids"]), r["doc_tokens"])):
                    yield w, False
            for w in packer.rest():
                yield w, True

        return pa.Table.from_batches(_rows(windows(), (level << 56) | (group << 32), group, capacity, last), _ARROW)

    return merge
