"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined with the templates'.
Each hit votes for a diagonal: the place in the text less the place in the
template. Votes are counted per diagonal, neighbouring diagonals (as far apart
as the template's allowed edits) are merged, and the spans of those with enough
votes are compared with the template word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.llm.common import written
from seqframe.llm.url_filter import bloom_blocks, may_contain
from seqframe.llm.words import words_of

#: Phrases that must stand word for word (fixed values).
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Openings of public license notices, found with some words changed (fixed values).
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
]
#: Words of all templates at most, checked: they bound the side of the join that every task holds.
MAX_TEMPLATE_WORDS = 500_000
GRAM = 3
_CHUNK = 50_000
_MAX_WORDS = 400_000
_U = np.uint64
SPANS = "array<struct<label string, exact boolean, start long, end long, similarity double>>"


class _Prints(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


class Grams:
    """Rolling hashes of ``GRAM`` words; words are hashed once."""

    def __init__(self):
        self.prints = _Prints()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(words) < GRAM:
            return np.zeros(0, np.int64)
        h = np.frombuffer(b"".join(map(self.prints.__getitem__, words)), ">u8").astype(_U)
        out = np.full(len(h) - GRAM + 1, _U(GRAM))
        for k in range(GRAM):
            out = (out ^ (out >> _U(29))) * _U(0x9E3779B97F4A7C15) + h[k:len(h) - GRAM + 1 + k]
        return (out ^ (out >> _U(32))).view(np.int64)


class Template:
    """A phrase or notice as words; ``edits`` word edits are allowed, none in a phrase."""

    def __init__(self, text: str, label: str, exact: bool, edit_percent: int):
        self.words, self.label, self.exact = words_of(text), label, exact
        self.edits = 0 if exact else len(self.words) * edit_percent // 100
        if len(self.words) < GRAM:
            raise ValueError(f"template {text!r} has fewer than {GRAM} words")
        #: Grams that any span within the allowed edits shares with the template, on diagonals at most ``edits`` apart.
        self.votes = max(1, len(self.words) - GRAM + 1 - GRAM * self.edits)


def templates_of(phrases=PHRASES, notices=NOTICES, edit_percent: int = 20) -> list[Template]:
    """Votes find every span of up to ``edit_percent`` % edits only while those leave a gram whole."""
    out = [Template(t, x, True, 0) for t, x in phrases] + [Template(t, x, False, edit_percent) for t, x in notices]
    if sum(len(t.words) for t in out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words together")
    for t in out:
        if len(t.words) - GRAM + 1 - GRAM * t.edits < 1:
            raise ValueError(f"{t.edits} edits can touch every gram of {b' '.join(t.words).decode()!r}")
    return out


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    grams = Grams()
    rows = [(int(h), i, p, t.edits, t.votes, len(t.words)) for i, t in enumerate(templates) for p, h in enumerate(grams.of(t.words))]
    return spark.createDataFrame(rows, "h long, template int, place int, edits int, votes int, n int")


def gram_hits(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, template, diagonal, votes and the template's numbers) of each diagonal with a hit; docs are (key, text)."""

    def run(batches):
        grams = Grams()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                h = grams.of(words_of(text.as_py()))
                for at in range(0, len(h), _CHUNK):
                    own = h[at:at + _CHUNK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()], pa.int64()), pa.array([at], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], names=["key", "at", "grams"])

    rows = docs.mapInArrow(run, "key long, at int, grams array<long>").select("key", "at", F.posexplode("grams").alias("i", "h"))
    hits = rows.join(F.broadcast(_positions(docs.sparkSession, templates)), "h")
    diagonal = (F.col("at") + F.col("i") - F.col("place")).alias("diagonal")
    return hits.groupBy("key", "template", diagonal, "edits", "votes", "n").agg(F.count("*").alias("own"))


def candidate_spans(diagonals: DataFrame) -> DataFrame:
    """(key, spans): where enough votes stand on neighbouring diagonals, as (template, lo, hi) in words."""
    w = W.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.col("edits"), F.lit(True))
    merged = diagonals.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(w))
    merged = merged.groupBy("key", "template", "group").agg(
        F.sum("own").alias("own"), F.first("votes").alias("votes"),
        F.greatest(F.min(F.col("diagonal") - F.col("edits")), F.lit(0)).alias("lo"), F.max(F.col("diagonal") + F.col("n") + F.col("edits")).alias("hi"))
    return merged.where(F.col("own") >= F.col("votes")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("template", "lo", "hi"))).alias("spans"))


def _ends(template: list[int], words: np.ndarray) -> np.ndarray:
    """Fewest word edits between the template and any run of words that ends before each place (0 to their number)."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for k, w in enumerate(template, 1):
        best = np.empty_like(row)
        best[0] = k
        best[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(best - at) + at
    return row


def verified(template: Template, words: list[bytes], lo: int, hi: int) -> list[tuple[int, int, float]]:
    """(start, end, similarity) of the template's places in the words from ``lo`` to ``hi``; of overlapping notices the nearest, then first."""
    hi, t = min(hi, len(words)), template.words
    if template.exact:
        return [(s, s + len(t), 1.0) for s in range(lo, hi - len(t) + 1) if words[s] == t[0] and words[s:s + len(t)] == t]
    ids = {w: i for i, w in enumerate(dict.fromkeys(t))}
    own, pattern = np.array([ids.get(w, -1) for w in words[lo:hi]], np.int64), [ids[w] for w in t]
    far = _ends(pattern, own)
    out: list[tuple[int, int, float]] = []
    ends = np.flatnonzero(far <= template.edits)
    for end in ends[np.argsort(far[ends], kind="stable")].tolist():
        first = max(0, end - len(t) - template.edits)
        back = _ends(pattern[::-1], own[first:end][::-1])  # the run's length, counted from its end
        start = end - int(np.flatnonzero(back == far[end])[0]) if far[end] in back else first
        if start < end and all(end <= s - lo or start >= e - lo for s, e, _ in out):
            out.append((start + lo, end + lo, 1 - int(far[end]) / len(t)))
    return sorted(out)


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and spans (label, exact, start, end in words, similarity) of every row, spans by start, end and label.

    A null or empty text has no word and no span, as has any text without a
    template's grams. Rows with null or repeated ids are judged each by its own
    text. A span shorter than a gram cannot be found, so no template may be.
    Other columns are ignored. Only rows whose key passes a Bloom filter of
    the keys with candidates are shuffled with their texts to be verified.
    """
    templates = templates_of() if templates is None else templates
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.col("doc_id"), F.col("text")))
    found = written(candidate_spans(gram_hits(rows.select("key", "text"), templates)), "license-candidates")
    blocks, n_blocks = bloom_blocks(found, "key", found.count())
    rows = may_contain(rows, "key", blocks, n_blocks, "maybe")
    hits = rows.where("maybe").join(found, "key", "left").select("doc_id", "text", "spans")
    clear = rows.where("not maybe").select("doc_id", "text")

    def counted(batches):
        for batch in batches:
            n = [len(words_of(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_words"])

    def compared(batches):
        for batch in batches:
            for i, doc in enumerate(batch.column(0).to_pylist()):
                words, out = words_of(batch.column(1)[i].as_py()), set()
                for c in batch.column(2)[i].as_py() or []:
                    t = templates[c["template"]]
                    out.update((start, end, t.label, t.exact, like) for start, end, like in verified(t, words, c["lo"], c["hi"]))
                spans = [{"label": x, "exact": e, "start": a, "end": b, "similarity": s} for a, b, x, e, s in sorted(out)]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([spans], _SPANS)],
                                                 names=["doc_id", "n_words", "spans"])

    none = F.array().cast(SPANS).alias("spans")
    return (clear.mapInArrow(counted, "doc_id long, n_words long").select("doc_id", "n_words", none)
            .unionAll(hits.mapInArrow(compared, f"doc_id long, n_words long, spans {SPANS}")))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())]))


def license_summary(spans: DataFrame) -> DataFrame:
    """n_base, first_word, last_word, base_labels, labels and score (the largest similarity) of ``scan_licenses``' rows."""
    base = F.filter("spans", lambda x: x["exact"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(x):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")

    return spans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("spans", lambda x: x["similarity"])), F.lit(0.0)).alias("score"))
