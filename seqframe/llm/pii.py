"""Personal data: fixed patterns, and terms that give them away.

Emails, IP addresses, card and phone numbers are protected entities. Terms that
share texts with an entity are counted over the corpus: a term's pointwise
mutual information with an entity, as a share of the entity's own information,
is how far the term discloses it. Terms above a threshold are generalised, above
a higher one removed, wherever they stand in any text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import text_or_empty, written
from seqframe.llm.url_filter import bloom_blocks, may_contain

#: Kinds in the order of results, with their patterns (fixed values, written so that no run of characters is tried twice).
KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a text must hold for a kind's pattern to be tried at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: A term: three letters or more that are part of no address and no longer word.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, both) -> Column:
    """For each item what ``both``, an associative function, makes of it and all before it, by steps of 1, 2, 4 and so on."""
    steps = lambda x: F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(x))
    return _let(items, lambda x: F.aggregate(steps(x), x, lambda acc, d: F.transform(
        acc, lambda v, i: F.when(i >= d, both(F.get(acc, i - d), v)).otherwise(v))))


def _located(text: Column, pattern: str) -> Column:
    """Matches with their code point places: the pieces between matches tell how far each one is from the last."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def spans(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0))), lambda x, y: x + y)
        return _let(ends, lambda ends: F.transform(pieces, lambda x, i: F.struct(
            (F.get(ends, i) - F.length(x["v"])).alias("s"), F.get(ends, i).alias("e"), x["v"].alias("v"))))

    # the piece after the last match has none
    return F.filter(_let(F.arrays_zip(between.alias("g"), found.alias("v")), spans), lambda x: x["v"].isNotNull())


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits' sum, every second one from the right doubled, ends in 0."""
    d = _digits(v)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<kind, s, e, v>> by kind, then start; ``kind`` is the place in ``KINDS``, ``e`` is exclusive."""
    kinds = []
    for k, name in enumerate(KINDS[:4]):
        found = F.filter(_located(text, PATTERNS[name]), lambda x: _VALID[name](x["v"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
        kinds.append(F.when(text.rlike(_HINT[name]), spans).otherwise(F.array().cast("array<struct<kind:int,s:int,e:int,v:string>>")))
    return F.concat(*kinds)


def blanked(text: Column, base: Column) -> Column:
    """The text with ``@`` for every code point inside a ``base`` span; places stay, and no term touches such a span."""
    return sanitised(text, F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.repeat(F.lit("@"), x["e"] - x["s"]).alias("tag"))))


def terms_of(text: Column, base: Column) -> Column:
    """array<string>: the distinct lower-cased terms of a text outside its ``base`` spans."""
    found = F.regexp_extract_all(blanked(text, base), F.lit(TERM), 0)
    return F.array_distinct(F.transform(found, lambda v: F.lower(v)))


def term_spans(text: Column, base: Column, listed: Column) -> Column:
    """array<struct<s, e, removed>>: where the terms of ``listed``, a map of term to ``removed``, stand outside ``base``."""
    spans = _let(blanked(text, base), lambda t: _located(t, TERM))
    spans = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.try_element_at(listed, F.lower(x["v"])).alias("removed")))
    return F.filter(spans, lambda x: x["removed"].isNotNull())


def occurrences(rows: DataFrame, terms: Column, wanted: DataFrame) -> DataFrame:
    """(__digest, term) of each text, less most terms not in ``wanted``: a filter of fixed size keeps them from the shuffle."""
    spread = rows.select("__digest", F.explode(terms).alias("term"))
    return may_contain(spread, "term", *bloom_blocks(wanted, "term", wanted.count()), "maybe").where("maybe").drop("maybe")


def disclosing_terms(rows: DataFrame, terms: Column, support: int, generalise: float, remove: float) -> DataFrame:
    """(entity, term, disclosure, removed) of the terms at or above ``generalise``.

    ``rows`` has ``__digest`` and ``__base`` of each text, ``terms`` gives its
    terms. Disclosure is PMI(entity; term) over the entity's information: 1 if
    the term never stands in a text without the entity, 0 if they are unrelated.
    A pair counts only with ``support`` distinct texts, so copies prove nothing;
    entities in fewer texts have no such pair and are left out before counting.
    """
    n_docs = float(max(rows.count(), 1))
    some = rows.where(F.size("__base") > 0)
    names = F.array_distinct(F.transform("__base", lambda x: F.concat_ws(":", x["kind"].cast("string"), F.lower(x["v"]))))
    found = written(some.select("__digest", F.explode(names).alias("entity")).groupBy("__digest", "entity").agg(F.count("*").alias("n")), "entities")
    entities = found.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    found = found.join(entities, "entity")
    held = some.join(found.select("__digest").distinct(), "__digest", "left_semi").select("__digest", terms.alias("terms"))
    held = held.groupBy("__digest").agg(F.first("terms").alias("terms"))
    pairs = found.join(held, "__digest").select("entity", "n_e", "n", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "n_e", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    pairs = written(pairs, "pairs")
    frequencies = occurrences(rows, terms, pairs.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n_t"))
    info = F.log2(F.lit(n_docs) / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * n_docs / (F.col("n_e") * F.col("n_t")))
    scored = pairs.join(frequencies, "term").withColumn("disclosure", F.when(info > 0, pmi / info).otherwise(F.lit(0.0)))
    return scored.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure", (F.col("disclosure") >= remove).alias("removed"))


def find_personal_data(docs: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95,
                       text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with a column ``pii``: array<struct<kind, s, e, tag>> of all spans by kind, then start.

    ``kind`` is the place in ``KINDS``; ``tag`` is what stands for the span in a
    sanitised text, empty for a removed term. A term that discloses any entity
    is a span wherever it stands, also in texts without the entity. A null or
    empty text has no span. Rows of one text get one answer; null or repeated
    ids need no care. A column named ``pii`` is replaced; other columns stay,
    the text only with ``keep_text``. An empty table stays empty.
    """
    text = text_or_empty(text_col)
    rows = written(docs.drop("pii").withColumn("__base", base_spans(text)).withColumn("__digest", F.sha2(text, 256)), "spans")
    own = terms_of(text, F.col("__base"))
    terms = disclosing_terms(rows, own, support, generalise, remove)
    terms = written(terms.groupBy("term").agg(F.max("removed").alias("removed")), "terms")
    hits = occurrences(rows, own, terms).join(terms, "term").groupBy("__digest", "term").agg(F.max("removed").alias("removed"))
    hits = written(hits.groupBy("__digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("__terms")), "hits")
    rows = may_contain(rows, "__digest", *bloom_blocks(hits, "__digest", hits.count()), "__maybe")
    base = F.transform("__base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.get(
        F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), x["kind"]).alias("tag")))
    added = F.transform(term_spans(text, F.col("__base"), F.col("__terms")), lambda x: F.struct(
        F.lit(4).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(x["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("tag")))
    empty = F.array().cast("array<struct<kind:int,s:int,e:int,tag:string>>")
    some = rows.where("__maybe").join(hits, "__digest", "left")
    some = some.withColumn("pii", F.concat(base, F.when(F.col("__terms").isNotNull(), added).otherwise(empty)))
    none = rows.where("not __maybe").withColumn("pii", F.concat(base, empty))
    out = [c for c in docs.columns if c != "pii" and (keep_text or c != text_col)] + ["pii"]
    return some.select(*out).unionAll(none.select(*out))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span's tag in its place; of overlapping spans the first one's stands for all."""
    width = 1024
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), 0)  # so that a cut does not count from the text's start

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / width).cast("int")
        some = F.slice(blocks, first + 1, F.floor(end / width).cast("int") - first + 1)
        return F.substr(F.array_join(some, ""), start - first * width + 1, end - start)

    def replaced(blocks: Column, ordered: Column, ends: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            return _let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda at: F.when(
                x["s"] >= at, F.concat(cut(blocks, at, x["s"]), x["tag"])).otherwise(F.lit("")))

        return F.concat(F.array_join(F.transform(ordered, piece), ""), F.substr(text, F.element_at(ends, -1) + 1, F.length(text)))

    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["tag"].alias("tag"))))
    clean = _let(ordered, lambda o: _let(_running(F.transform(o, lambda x: x["e"]), F.greatest), lambda ends: _let(
        blocks, lambda blocks: replaced(blocks, o, ends))))
    return F.when(F.size(spans) > 0, clean).otherwise(text)


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans in their order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
