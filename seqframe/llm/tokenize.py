"""Token ids of whole texts, as the tokenizers and sentencepiece libraries give them.

A byte-level BPE file splits a text into words before it merges, and a word
always begins at a space that a non-space follows. So a text is cut there, each
distinct piece is encoded once by the library, and a text's ids are its pieces'
ids in order. Texts with an added token's string, and all other tokenizer
kinds, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker remembers, about 250 MB; the store starts anew beyond it (a memory bound only).
MAX_PIECES = 1_200_000
#: Marks that may close a word (fixed set).
_MARKS = ".,;:!?"
_CUT = re.compile(r"(?= \S)")
_LOADED: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """A file's place: ``name`` itself if it is a path, else the installed public file of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    """SHA-256 of the tokenizer file: its version."""
    import hashlib

    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoder(name: str) -> "Encoder":
    """The worker's encoder of that tokenizer; kept, with its store, from task to task."""
    path = tokenizer_path(name)
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [np.array(x, "<u4").tobytes() for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [np.array(x.ids, "<u4").tobytes()
                                    for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        pre = says.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and says.get("normalizer") is None and says["model"]["type"] == "BPE")
        if self.by_piece:
            self.added = [x["content"] for x in says["added_tokens"]]
            # a byte-level vocabulary writes bytes as characters: printable ones as they are, the others from 256 on
            same = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = [b for b in range(256) if b not in same]
            self.byte_chars = {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(other)}
            self.space = self.byte_chars[32]
            self.merge = model.model.tokenize
            self.line_feed = self._word("\n")

    def _word(self, word: str) -> bytes:
        """Ids of one word as the pre-tokenizer would hand it to the merges."""
        if word.isascii() and word.removeprefix(" ").isalpha():  # letters stand for their own bytes
            chars = word.replace(" ", self.space)
        else:
            chars = word.encode().decode("latin-1").translate(self.byte_chars)
        ids = [x.id for x in self.merge(chars)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: list[str]) -> None:
        """Ids of distinct pieces. A piece stands for itself after a space; without one if it begins with a space or a line feed.

        Latin letters, then closing marks, are two words to the pre-tokenizer;
        any other piece goes through the library whole.
        """
        odd = []
        for p in new:
            if p[0] == "\n":
                lead, text = self.line_feed, p[1:]
            else:
                lead, text = b"", p[1:] if p[0] == " " else " " + p
            core = text.rstrip(_MARKS)
            letters = core.removeprefix(" ")
            if letters.isalpha() and max(letters) < "\u0250":
                ids = lead + self._word(core)
                if len(core) < len(text):
                    marks = text[len(core):]
                    ids += self.marks.get(marks) or self.marks.setdefault(marks, self._word(marks))
                self.pieces[p] = ids
            else:
                odd.append((p, p if lead else text))
        for (p, _), ids in zip(odd, self.whole([t for _, t in odd])):
            self.pieces[p] = ids

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.whole(texts)
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):  # about 4 MB of text at a time
            size, own, whole = 0, [], []
            while at < len(texts) and size < 4_000_000:
                text = texts[at]
                size += len(text)
                if any(x in text for x in self.added):
                    whole.append(at)
                elif text:
                    own.append(at)
                at += 1
            apart = [_lines_apart(texts[i]) for i in own]
            pieces, codes, ends = _split(apart)
            for i, x in zip(own, self._joined(pieces, codes, ends)):
                out[i] = x
            # these ids hold for texts without a space before a space or the end; a text whose lines were cut apart has none
            bad = np.array([not p or p[0].isspace() for p in pieces])
            bad[len(bad) - len(own):] = False  # the texts' first pieces, which follow no space
            glued = np.add.reduceat(bad[codes], ends[:-1]) > 0 if len(own) else []
            for i, text, odd in zip(own, apart, glued):
                if not odd or text is not texts[i]:
                    continue
                parts = [x for x in _CUT.split(texts[i]) if x]
                parts = [x[1:] if x[0] == " " and len(x) > 1 and not x[1].isspace() else " " + x for x in parts]
                self._know(set(parts))
                out[i] = b"".join([self.pieces[p] for p in parts])
            for i, x in zip(whole, self.whole([texts[i] for i in whole])):
                out[i] = x
        return out

    def _know(self, pieces: set[str]) -> None:
        new = pieces.difference(self.pieces)
        if len(self.pieces) + len(new) > MAX_PIECES:
            self.pieces.clear()
            self.marks.clear()
            new = pieces
        self._learn(list(new))

    def _joined(self, pieces: list[str], codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of texts given as codes of distinct pieces, text after text; an empty piece has none."""
        self._know(set(pieces) - {""})
        own = [self.pieces[p] if p else b"" for p in pieces]
        table, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, n = np.cumsum(sizes) - sizes, sizes[codes]
        upto = np.cumsum(n)
        ids = table[np.repeat(starts[codes] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.concatenate([[0], upto])[ends]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _lines_apart(text: str) -> str:
    """A line feed alone between two words is a word of its own: cut before it too, if all that parts the words is single spaces and line feeds."""
    if "\n" not in text:
        return text
    words, n = text.split(), text.count(" ") + text.count("\n")
    return text.replace("\n", " \n") if len(words) == n + 1 and sum(map(len, words)) + n == len(text) else text


def _split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of texts between single spaces, then each text's first piece; codes of all pieces; where each text's begin, and the end."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    ends = lists.offsets.to_numpy()
    found = lists.values.dictionary_encode()
    codes, pieces = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
    heads = [pieces[c] for c in codes[ends[:-1]]]  # a text's first piece has no space before it
    codes[ends[:-1]] = np.arange(len(pieces), len(pieces) + len(heads))
    return pieces + [" " + h if h else "" for h in heads], codes, ends


#: Bytes of text that are held as Python strings, with their ids, at a time.
_SLICE_BYTES = 6 << 20


def encoded(batches: Iterable, text: int, name: str) -> Iterator[tuple]:
    """(batch, ids of each of its rows) for slices of the batches of about ``_SLICE_BYTES``; a null text counts as empty."""
    enc = encoder(name)
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + _SLICE_BYTES, side="right")))
            own = batch.slice(lo, hi - lo)
            yield own, enc.ids([x or "" for x in own.column(text).to_pylist()])
            lo = hi
