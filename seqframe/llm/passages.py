"""Removal of byte strings that an earlier document holds: a sampled suffix order in fingerprint buckets.

A document's suffixes are sampled at anchors: positions whose 24-byte gram has
the smallest fingerprint in some stretch of 27 grams, so every 50-byte string
holds an anchor and equal strings hold the same one. Suffixes are ordered by
the fingerprint of their leading bytes, range-partitioned into buckets and
sorted there; equal neighbours of different documents stand for a shared gram.
Only around shared anchors are longer strings compared, in two further rounds:
the whole context of an anchor, then single 50-byte windows where contexts
differ. A block of documents sends each distinct key of a round once and gets
one bit per key back, so a passage that very many documents hold costs a bucket
one row per block, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import row_key, text_or_empty

LENGTH, GRAM = 50, 24
STRETCH = LENGTH - GRAM + 1
HALF = GRAM + (LENGTH - GRAM) // 2  # a window reaches this far to the left or to the right of any gram in it
U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=U)  # a fixed random number for each byte
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_PLACES: list[np.ndarray] = [np.arange(1, dtype=U)]
_UPPER = U(0xFFFFFFFF00000000)
#: Bytes of text that are put end to end and taken at a time; a longer text is taken by itself.
TAKEN = 1 << 16
_KEYS = "block int, bucket int, keys binary, docs binary"
_BITS = "block int, bucket int, smaller binary, shared binary"
_KEYS_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
_BITS_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("smaller", pa.binary()), ("shared", pa.binary())])
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT_TEXT = _OUT + ", kept binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(29))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, modulo 2 ** 64."""
    if n > len(_POWERS[0]):
        size = max(n, 2 * len(_POWERS[0]))
        for k, step in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            x = np.full(size, step, U)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def _places(n: int) -> np.ndarray:
    if n > len(_PLACES[0]):
        _PLACES[0] = np.arange(max(n, 2 * len(_PLACES[0])), dtype=U)
    return _PLACES[0][:n]


class Prints:
    """Texts put end to end, each of 50 bytes at least, and the fingerprints of any stretch of them, from sums over prefixes."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.text, self.ends, self.starts = text, ends, np.r_[0, ends[:-1]]
        up, self.down = _powers(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, U)
        np.cumsum(_BYTES[text] * up[: len(text)], out=self.sums[1:])

    def order(self, length: int) -> np.ndarray:
        """For every stretch of that length a number by which equal ones, also of other texts, stand next to each other: 32 bits
        of its fingerprint and then its place."""
        x = (self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length]
        x &= _UPPER
        x |= _places(len(x))
        return x

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of the given stretches."""
        return _mixed((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] ^ lengths.astype(U))


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    return take(x[:-(width - size)], x[width - size:]) if width > size else x


def anchors(prints: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, the number of each one's text, and the first and last start of its 50-byte windows.

    A window's anchor is the first gram in it with the smallest fingerprint, so
    the windows of an anchor follow each other. No window leaves its text.
    """
    own = (_sliding(prints.order(GRAM), STRETCH, np.minimum) & ~_UPPER).view(np.int64)
    inside = np.ones(len(own), bool)
    inside[(prints.ends[:-1, None] - np.arange(1, LENGTH)).ravel()] = False
    new = inside.copy()
    new[1:] &= (own[1:] != own[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    at = own[first]
    doc = np.searchsorted(prints.ends, at, "right")
    return at, doc, first, np.minimum(np.r_[first[1:], len(own)] - 1, prints.ends[doc] - LENGTH)


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their bytes, which compress well in a shuffle; the first byte is the number of planes."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return out.view("<u8").ravel()


def _send(block: int, keys: np.ndarray, docs: np.ndarray, buckets: int, with_docs: bool = True, first: int = 0) -> Iterator[tuple]:
    """(block, bucket, steps between sorted distinct keys, smallest document of each); buckets are numbered from ``first``."""
    if not len(keys):
        return
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, docs = keys[at], np.minimum.reduceat(docs[order], at) if with_docs else docs
    where = (keys >> U(32)) * U(buckets) >> U(32)
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
        sent = _packed(docs[lo:hi].view(U)) if with_docs else b""
        yield block, first + int(where[lo]), _packed(np.r_[keys[lo], np.diff(keys[lo:hi])]), sent


def _found(keys: np.ndarray, docs: np.ndarray, answers: dict[int, tuple[bytes, bytes]], buckets: int,
           first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each (key, document): whether a smaller document has the key, and whether any other has; here or in another block."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    distinct, least, most = k[at], np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
    where = ((distinct >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    smaller, shared = np.zeros(len(distinct), bool), most > least
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    for lo, hi in zip(cuts, [*cuts[1:], len(distinct)]):
        if bits := answers.get(first + int(where[lo])):
            smaller[lo:hi] = np.unpackbits(np.frombuffer(bits[0], np.uint8), count=hi - lo)
            shared[lo:hi] |= np.unpackbits(np.frombuffer(bits[1], np.uint8), count=hi - lo).astype(bool)
    less, other = np.empty(len(keys), bool), np.empty(len(keys), bool)
    less[order] = (d > least[group]) | smaller[group]
    other[order] = shared[group]
    return less, other


def _answer(table: pa.Table) -> Iterator[tuple]:
    """In one bucket: sort all keys; tell each block which of its keys another block has, with a smaller document and at all."""
    rows = list(zip(*[table.column(x).to_pylist() for x in ("block", "bucket", "keys", "docs")]))
    each = [np.cumsum(_unpacked(r[2]), dtype=U) for r in rows]
    keys = np.concatenate(each)
    docs = np.concatenate([_unpacked(r[3]).view(np.int64) if r[3] else np.zeros(len(x), np.int64) for r, x in zip(rows, each)])
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    least, shared = np.empty(len(k), np.int64), np.empty(len(k), bool)
    least[order] = np.minimum.reduceat(docs[order], at)[group]
    shared[order] = (np.diff(np.r_[at, len(k)]) > 1)[group]
    lo = 0
    for (block, bucket, _, _), x in zip(rows, each):
        hi = lo + len(x)
        if shared[lo:hi].any():
            yield block, bucket, np.packbits(least[lo:hi] < docs[lo:hi]).tobytes(), np.packbits(shared[lo:hi]).tobytes()
        lo = hi


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first to its last one."""
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


class Part:
    """Some texts of a block, end to end, with their documents and anchors."""

    def __init__(self, ids: np.ndarray, text: np.ndarray, ends: np.ndarray):
        self.ids, self.prints = ids, Prints(text, ends)
        self.at, self.doc, self.first, self.last = anchors(self.prints)


def _is_compared(table: pa.Table) -> pa.ChunkedArray:
    return pc.and_(pc.is_valid(table.column("doc_id")), pc.greater_equal(pc.binary_length(table.column("t")), LENGTH))


def _parts(table: pa.Table) -> Iterator[Part]:
    """The rows of a block that are compared, in parts of about ``TAKEN`` bytes."""
    for batch in table.select(["doc_id", "t"]).filter(_is_compared(table)).combine_chunks().to_batches():
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        part = (offsets[1:] - offsets[0] - 1) // TAKEN
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
            yield Part(ids[lo:hi], data[offsets[lo]:offsets[hi]], offsets[lo + 1:hi + 1] - offsets[lo])


class Rounds:
    """What a block of documents asks in each round, and what the answers leave open."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets, self.parts = buckets, list(_parts(table))
        self.doc = _joined([x.ids[x.doc] for x in self.parts], np.int64)

    def grams(self) -> np.ndarray:
        """The anchors' prints without their last bits: a wrong match here only has more compared."""
        return _joined([x.prints.of(x.at, np.full(len(x.at), GRAM)) for x in self.parts], U) & U(0xFFFFFFFFFF000000)

    def contexts(self, open_: np.ndarray):
        """For each part its open anchors' documents, first and last windows, and the keys of their contexts, left and right halves."""
        lo = 0
        for x in self.parts:
            pick = np.flatnonzero(open_[lo:lo + len(x.at)])
            lo += len(x.at)
            p, a, d, f, e = x.prints, x.at[pick], x.doc[pick], x.first[pick], x.last[pick]
            has_left, has_right = a - (HALF - GRAM) >= p.starts[d], a + HALF <= p.ends[d]
            left = p.of(a[has_left] - (HALF - GRAM), np.full(has_left.sum(), HALF)) ^ U(0x5555)
            right = p.of(a[has_right], np.full(has_right.sum(), HALF)) ^ U(0xAAAA)
            yield x, x.ids[d], f, e, p.of(f, e + LENGTH - f), left, right, has_left, has_right

    def ask_contexts(self, contexts: list[tuple]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Keys and documents of the whole contexts, and of the halves, of which only is asked whether they are shared;
        these without their last bits, as a wrong match only has more compared."""
        halves, docs = [], []
        for _, ids, _, _, _, left, right, has_left, has_right in contexts:
            halves += [left, right]
            docs += [ids[has_left], ids[has_right]]
        whole = _joined([x[4] for x in contexts], U), _joined([x[1] for x in contexts], np.int64)
        return whole, (_joined(halves, U) & U(0xFFFFFFFFFFFF0000), _joined(docs, np.int64))

    def after_contexts(self, contexts: list[tuple], smaller: np.ndarray, shared: np.ndarray):
        """(part, its settled windows, its windows still to be compared, the documents of these) in the order of the parts.

        Settled: a smaller document has the whole context. To be compared: some
        other document has the left or the right half; the smallest document
        with a window is always among these.
        """
        lo = at = 0
        for x, ids, f, e, whole, left, right, has_left, has_right in contexts:
            n, nl, nr = len(whole), len(left), len(right)
            settled, half = smaller[lo:lo + n], np.zeros(n, bool)
            half[has_left] = shared[at:at + nl]
            half[has_right] |= shared[at + nl:at + nl + nr]
            lo, at = lo + n, at + nl + nr
            open_ = ~settled & half
            yield x, _spans(f[settled], e[settled]), _spans(f[open_], e[open_]), np.repeat(ids[open_], e[open_] - f[open_] + 1)


def remove_repeats(docs: DataFrame, block_bytes: int = 3 << 20, bucket_bytes: int = 8 << 20,
                   id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (with ``keep_bytes`` also what is kept).

    Removed is each byte inside a 50-byte string of the text's UTF-8 that also
    starts in a row with a smaller id. Strings are judged on the input;
    overlaps count. A null text is empty. A row without an id is compared with
    none; rows of one id are not compared with each other. Shorter texts than
    50 bytes stay. Texts are dealt to blocks by id, about ``block_bytes`` each,
    in one shuffle that all rounds read.
    """
    text = text_or_empty(text_col)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = max(1, total // block_bytes), max(1, total // bucket_bytes)
    dealt = docs.select(F.pmod(row_key(id_col, text_col), F.lit(blocks)).cast("int").alias("block"),
                        F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("t")).repartition("block")

    def requests(answers: DataFrame | None, round_: int) -> DataFrame:
        if answers is None:
            def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                return _table(_rounds(table, None, round_, buckets), _KEYS_ARROW)
            return dealt.groupBy("block").applyInArrow(ask, _KEYS)

        def ask_more(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
            return _table(_rounds(table, told, round_, buckets), _KEYS_ARROW)
        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_more, _KEYS)

    def answered(asked: DataFrame, round_: int) -> DataFrame:
        def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _table(_answer(table), _BITS_ARROW)
        return asked.groupBy("bucket").applyInArrow(answer, _BITS).withColumn("round", F.lit(round_))

    told = answered(requests(None, 1), 1)
    told = told.unionAll(answered(requests(told, 2), 2))
    told = told.unionAll(answered(requests(told, 3), 3))
    schema = _OUT_TEXT if keep_bytes else _OUT

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        rows = list(_finished(table, told, buckets, keep_bytes))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table({n: pa.array(c, pa.string() if n == "kept_sha256" else pa.binary() if n == "kept" else pa.int64())
                         for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))})

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def _table(rows, schema: pa.Schema) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _of_round(told: pa.Table, round_: int) -> dict[int, tuple[bytes, bytes]]:
    columns = [told.column(c).to_pylist() for c in ("bucket", "round", "smaller", "shared")]
    return {b: (x, y) for b, r, x, y in zip(*columns) if r == round_}


def _windows_asked(r: Rounds, told: pa.Table) -> list[tuple]:
    """(part, settled windows, open windows, their documents) once the contexts are answered."""
    _, open_ = _found(r.grams(), r.doc, _of_round(told, 1), r.buckets)
    contexts = list(r.contexts(open_))
    whole, halves = r.ask_contexts(contexts)
    answers = _of_round(told, 2)
    return list(r.after_contexts(contexts, _found(*whole, answers, r.buckets)[0], _found(*halves, answers, r.buckets, first=r.buckets)[1]))


def _open_keys(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    keys = [x.prints.of(w, np.full(len(w), LENGTH)) for x, _, w, _ in found]
    return _joined(keys, U), _joined([docs for *_, docs in found], np.int64)


def _rounds(table: pa.Table, told: pa.Table | None, round_: int, buckets: int) -> Iterator[tuple]:
    if not table.num_rows:
        return
    block = table.column("block")[0].as_py()
    r = Rounds(table, buckets)
    if round_ == 1:
        yield from _send(block, r.grams(), r.doc, buckets, with_docs=False)  # only whether a gram is shared
    elif round_ == 2:
        open_ = _found(r.grams(), r.doc, _of_round(told, 1), r.buckets)[1]
        whole, halves = r.ask_contexts(list(r.contexts(open_)))
        yield from _send(block, *whole, buckets)
        yield from _send(block, *halves, buckets, with_docs=False, first=buckets)
    else:
        yield from _send(block, *_open_keys(_windows_asked(r, told)), buckets)


def _finished(table: pa.Table, told: pa.Table, buckets: int, keep_bytes: bool) -> Iterator[tuple]:
    if not table.num_rows:
        return

    def row(i, n: int, n_spans: int, kept: bytes) -> tuple:
        out = i, n, n - len(kept), n_spans, hashlib.sha256(kept).hexdigest()
        return (*out, kept) if keep_bytes else out

    rest = table.filter(pc.invert(_is_compared(table)))
    for i, t in zip(rest.column("doc_id").to_pylist(), rest.column("t").to_pylist()):
        yield row(i, len(t), 0, t)
    found = _windows_asked(Rounds(table, buckets), told)
    keys, docs = _open_keys(found)
    hit, lo = _found(keys, docs, _of_round(told, 3), buckets)[0], 0
    for x, settled, open_, _ in found:
        starts = np.concatenate([settled, open_[hit[lo:lo + len(open_)]]])
        lo += len(open_)
        p = x.prints
        n = len(p.text) + 1
        is_kept = np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + LENGTH, minlength=n))[:-1] == 0
        begins = ~is_kept
        begins[1:] &= is_kept[:-1]
        begins[p.starts] = ~is_kept[p.starts]
        n_spans = np.add.reduceat(begins.astype(np.int64), p.starts)
        kept, ends = p.text[is_kept].tobytes(), np.cumsum(is_kept)[p.ends - 1]
        for i, size, m, a, b in zip(x.ids.tolist(), (p.ends - p.starts).tolist(), n_spans.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            yield row(i, size, m, kept[a:b])
