"""Registered queries: sequence views, scalar functions, tokens, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.functions import sequences as sq
from seqframe.functions import tokens as tk
from seqframe.functions.hashing import stable_hash_sql
from seqframe.operators import context as ctx
from seqframe.operators import relational as rel
from seqframe.plans import sqlparts as q
from seqframe.plans.registry import query
from seqframe.sources import tables as t

VOCAB_CHARS = "".join(v for v in tk.VOCAB[4:31] if len(v) == 1)  # single-letter tokens, ids 4..


@query("aligned_sequences", ("X1", "S3-view"),
       q.with_ctes(q.SEQS, q.WT, body="""SELECT CAST(seq_id AS BIGINT) AS seq_id, sequence FROM seqs, wt
WHERE length(sequence) BETWEEN length(wt_sequence) // 2 AND 2 * length(wt_sequence)"""))
def aligned_sequences(spark, sf):
    """The documents' whole residue strings that have the wild type's length to within a factor of two (P2 on the true length)."""
    n = t.wild_type(t.references(spark, sf)).select(F.length("wt_sequence").alias("_n"))
    s = rel.attach_row(t.seqs(spark, sf), n).where("length(sequence) BETWEEN _n div 2 AND 2 * _n")
    return s.select(F.col("seq_id").cast("bigint"), "sequence")


@query("fixed_length_sequences", ("P2",), q.with_ctes(q.SEQS, body=""",
n AS (SELECT length(sequence) AS n FROM seqs GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(length(sequence) AS BIGINT) AS n, md5(sequence) AS sequence_md5
FROM seqs WHERE length(sequence) = (SELECT n FROM n)"""))
def fixed_length_sequences(spark, sf):
    """The sequences of one length, the family's most frequent (the longest of equals), as a feature table needs them."""
    s = t.seqs(spark, sf)
    n = s.groupBy(F.length("sequence").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()["n"]
    return rel.filter_length(s, "sequence", n).select(F.col("seq_id").cast("bigint"), F.length("sequence").cast("bigint").alias("n"),
                                                      F.md5("sequence").alias("sequence_md5"))


def _in_order(places, key, width, *parts):
    """(key, n, n_marked, last_pos, md5): of each key's places (pos, marked) the md5 of their letters in the order of
    the places: any letter at another place changes it. ``width`` characters a place."""
    x = F.concat(*parts)
    g = rel.place_runs(places.select(key, "pos", x.alias("x"), "marked"), key, width).groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("n_marked").alias("n_marked"), F.max(F.col("pos") + F.col("n") - 1).alias("last_pos"),
        F.array_sort(F.collect_list(F.struct("pos", "x", "n"))).alias("_runs"))
    return g.select(key, "n", "n_marked", "last_pos", F.md5(rel.joined_runs("_runs", width)).alias("md5"))


@query("residue_table", ("X1", "residues"),
       q.with_ctes(q.RESIDUES, body="""SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(count(*) AS BIGINT) AS n,
  CAST(max(pos) AS BIGINT) AS last_pos, md5(string_agg(aa, '' ORDER BY pos)) AS letters_md5 FROM residues GROUP BY seq_id"""))
def residue_table(spark, sf):
    """All residues with their places; a digest per sequence covers every row in order."""
    r = _in_order(t.residues(spark, sf).withColumn("marked", F.lit(False)), "seq_id", 1, "aa")
    return r.select(F.col("seq_id").cast("bigint"), "n", "last_pos", F.col("md5").alias("letters_md5"))


SEQUENCE_FORMS_SQL = """
WITH l AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CAST(length(s) AS BIGINT) AS n_letters,
       CAST(length(s) - length(regexp_replace(s, '[UZOB]', '', 'g')) AS BIGINT) AS n_rare,
       md5(array_to_string(string_split(regexp_replace(s, '[UZOB]', 'X', 'g'), ''), ' ')) AS spaced_md5,
       md5('<AA2fold> ' || array_to_string(string_split(regexp_replace(s, '[UZOB]', 'X', 'g'), ''), ' ')) AS fold_md5,
       md5(s) AS plain_md5,
       substr(s, 3, 1) AS third_residue
FROM l WHERE length(s) > 0
"""


@query("sequence_forms", ("X3", "X4", "X5", "X6", "X11"), SEQUENCE_FORMS_SQL)
def sequence_forms(spark, sf):
    """Encoder input forms of every document's letter string (whole text)."""
    d = t.table(spark, sf, "documents").select("doc_id", sq.ascii_letters_upper("text").alias("s"))
    d = d.where(F.length("s") > 0)
    return d.select(
        F.col("doc_id").cast("bigint"),
        F.length("s").cast("bigint").alias("n_letters"),
        (F.length("s") - F.length(F.regexp_replace("s", "[UZOB]", ""))).cast("bigint").alias("n_rare"),
        F.md5(sq.prepare_sequence("s", "spaced")).alias("spaced_md5"),
        F.md5(sq.prepare_sequence("s", "fold")).alias("fold_md5"),
        F.md5(sq.prepare_sequence("s", "plain")).alias("plain_md5"),
        sq.residue_at("s", 3).alias("third_residue"),
    )


REMOVE_INSERTIONS_SQL = """
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CAST(length(translate(text, 'abcdefghijklmnopqrstuvwxyz.*', '')) AS BIGINT) AS n_kept,
       md5(translate(text, 'abcdefghijklmnopqrstuvwxyz.*', '')) AS kept_md5
FROM documents
"""


@query("remove_insertions", ("X12",), REMOVE_INSERTIONS_SQL)
def remove_insertions_q(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", sq.remove_insertions("text").alias("k"))
    return d.select(F.col("doc_id").cast("bigint"), F.length("k").cast("bigint").alias("n_kept"),
                    F.md5("k").alias("kept_md5"))


@query("url_base_names", ("X17",),
       "SELECT CAST(page_id AS BIGINT) AS page_id, string_split(url, '/')[-1] AS base_name FROM pages")
def url_base_names(spark, sf):
    p = t.table(spark, sf, "pages")
    return p.select(F.col("page_id").cast("bigint"), sq.base_name("url").alias("base_name"))


TOKENS_SQL = f"""
WITH l AS (SELECT conv_id, turn, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM conversations),
k AS (SELECT conv_id, turn,
        [0] || list_transform(string_split(s, '')[1:{tk.MAX_LENGTH - 2}],
               lambda x: CASE WHEN strpos('{VOCAB_CHARS}', x) > 0 THEN strpos('{VOCAB_CHARS}', x) + 3 ELSE 3 END) || [2] AS ids
      FROM l WHERE length(s) > 0),
m AS (SELECT max(len(ids)) AS width FROM k)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CAST(len(ids) AS BIGINT) AS n_tokens,
       md5(array_to_string(ids || list_transform(range(width - len(ids)), lambda x: 1), ',')) AS padded_md5,
       CAST(list_sum(ids) AS BIGINT) AS id_sum,
       CAST(width AS BIGINT) AS width
FROM k CROSS JOIN m
"""


@query("tokenize_pad", ("K1", "K2", "A21"), TOKENS_SQL)
def tokenize_pad(spark, sf):
    """Token ids with begin/end tokens (truncated to 1024), padded to the
    longest row; the width is one aggregate joined back as a 1-row table."""
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", sq.ascii_letters_upper("text").alias("s"))
    k = c.where(F.length("s") > 0).withColumn("ids", tk.tokenize("s"))
    width = k.agg(F.max(F.size("ids")).alias("width"))
    k = rel.attach_row(k, width)  # one row
    padded = tk.pad("ids", F.col("width"))
    return k.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(padded, ",")).alias("padded_md5"),
        F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.col("width").cast("bigint"),
    )


MLM_SQL = q.with_ctes(q.RESIDUES, body=f""",
u AS (SELECT seq_id, pos, aa,
        {stable_hash_sql('42:pick', 'seq_id', 'pos')} / 4294967296.0 AS u1,
        {stable_hash_sql('42:kind', 'seq_id', 'pos')} / 4294967296.0 AS u2,
        substr('ACDEFGHIKLMNPQRSTVWY', CAST({stable_hash_sql('42:rand', 'seq_id', 'pos')} % 20 + 1 AS INTEGER), 1) AS rnd
      FROM residues),
m AS (SELECT seq_id, pos, aa,
       CASE WHEN u1 >= 0.15 THEN aa WHEN u2 < 0.8 THEN '#' WHEN u2 < 0.9 THEN rnd ELSE aa END AS input,
       CASE WHEN u1 < 0.15 THEN aa END AS label
FROM u)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(count(*) AS BIGINT) AS n, CAST(count(label) AS BIGINT) AS n_labels,
       md5(string_agg(input || coalesce(label, '-'), '' ORDER BY pos)) AS sites_md5
FROM m GROUP BY seq_id""")


@query("mlm_masking", ("K3",), MLM_SQL)
def mlm_masking(spark, sf):
    """Masked input and label of every residue; a digest per sequence covers every row in order."""
    m = ctx.mlm_mask(t.seqs(spark, sf)).withColumn("marked", F.col("label").isNotNull())
    m = _in_order(m, "seq_id", 2, "input", F.coalesce("label", F.lit("-")))
    return m.select(F.col("seq_id").cast("bigint"), "n", F.col("n_marked").alias("n_labels"), F.col("md5").alias("sites_md5"))


MASK_EACH_SQL = q.with_ctes(q.REFS, body=""",
s AS (SELECT seq_id, sequence, unnest(generate_series(1, length(sequence))) AS pos FROM refs)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(pos AS BIGINT) AS pos, substr(sequence, pos, 1) AS aa,
       substr(sequence, 1, pos - 1) || '#' || substr(sequence, pos + 1) AS masked
FROM s""")


@query("masked_copies", ("K4",), MASK_EACH_SQL)
def masked_copies(spark, sf):
    """A copy per position is quadratic in a sequence's length, so the operator is for reference proteins, not texts."""
    m = ctx.mask_each_position(t.references(spark, sf))
    return m.select(F.col("seq_id").cast("bigint"), F.col("pos").cast("bigint"), "aa", "masked")


@query("keyless_row_ids", ("P9",),
       "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_ids, "
       "CAST(0 AS BIGINT) AS n_dup_ids FROM conversations")
def keyless_row_ids(spark, sf):
    """Ids for a table read without its key (the text column only).
    Uniqueness is checked by a shuffle on the id, not on the driver."""
    x = rel.with_row_id(t.table(spark, sf, "conversations").select("text"))
    per_id = x.groupBy("row_id").agg(F.count(F.lit(1)).alias("c"))
    return per_id.agg(F.sum("c").cast("bigint").alias("n_rows"),
                      F.count(F.lit(1)).cast("bigint").alias("n_ids"),
                      F.coalesce(F.sum(F.when(F.col("c") > 1, F.lit(1))), F.lit(0)).cast("bigint").alias("n_dup_ids"))
