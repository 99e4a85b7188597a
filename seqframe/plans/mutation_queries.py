"""Registered queries: mutation scanning and zero-shot scoring (Z*, J5-J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.operators import context as ctx
from seqframe.functions import udtf
from seqframe.functions.hashing import stable_hash_sql
from seqframe.operators import mutants as mz
from seqframe.operators import relational as rel
from seqframe.operators import split as sp
from seqframe.operators.ranking import row_number_by
from seqframe.plans import sqlparts as q
from seqframe.plans.registry import query
from seqframe.session import checked_broadcast, cut_lineage
from seqframe.sources import tables as t

R = 6  # decimals kept in float outputs compared with the oracle


FLAGSHIP_SQL = q.with_ctes(q.RESIDUES, q.ALPHA, q.profile(), q.WT, q.SINGLE_MUTATIONS, body=""", scored AS (
  SELECT m.mutant, m.pos, pm.log_prob - pw.log_prob AS score
  FROM muts m JOIN profile pm ON pm.pos = m.pos AND pm.aa = m.mt
              JOIN profile pw ON pw.pos = m.pos AND pw.aa = m.wt)
SELECT mutant, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score
FROM scored ORDER BY round(score, 9) DESC, mutant LIMIT 10""")


def _profile_and_reference(spark, sf):
    """Profile and residue counts from one aggregation over the family's
    residues (the documents are scanned once), and the wild type's residues."""
    counts = cut_lineage(ctx.residue_counts(ctx.counted_residues(t.seqs(spark, sf))))  # <= L x 20 rows
    wt_res = mz.wt_residues(t.wild_type(t.references(spark, sf)))
    return ctx.site_profile_from_counts(counts), wt_res, counts


@query("mutant_scan_top10", ("A23", "A17", "J6", "Z1", "Z3", "Z9", "J5", "T2"), FLAGSHIP_SQL)
def mutant_scan_top10(spark, sf):
    """Score every single-residue mutant of the wild type against the
    family's site profile and keep the ten best."""
    prof, wt_res, _ = _profile_and_reference(spark, sf)
    muts = mz.mutations_of_residues(wt_res)
    scored = mz.score_mutations(muts, prof)
    top = scored.orderBy(F.round("score", 9).desc(), "mutant").limit(10)
    return top.select("mutant", "pos", F.round("score", R).alias("score"))


@query("single_mutations", ("Z1", "J6", "X9", "D1"),
       q.with_ctes(q.ALPHA, q.WT, q.SINGLE_MUTATIONS,
                   body="SELECT mutant, wt, CAST(pos AS BIGINT) AS pos, mt FROM muts"))
def single_mutations_q(spark, sf):
    wt = t.wild_type(t.references(spark, sf))
    m = mz.single_mutations(wt)
    return m.select("mutant", "wt", F.col("pos").cast("bigint"), "mt")


@query("mutant_generator", ("D5",), q.with_ctes(q.REFS, q.ALPHA, body="""
SELECT CAST(seq_id AS BIGINT) AS seq_id, substr(sequence, i, 1) || CAST(i + 23 AS VARCHAR) || aa AS mutant, CAST(i AS INTEGER) AS pos
FROM (SELECT *, CAST(unnest(generate_series(1, length(sequence))) AS INTEGER) AS i FROM refs) CROSS JOIN alpha"""))
def mutant_generator(spark, sf):
    """The one-to-many generator as SQL users call it, in a lateral join over every reference protein."""
    udtf.register(spark)
    refs = t.references(spark, sf)
    return spark.sql("SELECT CAST(r.seq_id AS BIGINT) AS seq_id, m.mutant, m.pos FROM {refs} r, LATERAL single_mutants(r.sequence, 24) m", refs=refs)


@query("single_residue_mutants", ("Z2", "X10"), q.with_ctes(q.ALPHA, q.WT, q.SINGLE_MUTATIONS, body="""
SELECT m.mutant, CAST(m.pos AS BIGINT) AS pos, m.mt,
       substr(w.wt_sequence, 1, m.pos - 1) || m.mt || substr(w.wt_sequence, m.pos + 1) AS mutant_sequence
FROM muts m CROSS JOIN wt w WHERE m.mt <> m.wt"""))
def single_residue_mutants_q(spark, sf):
    wt = t.wild_type(t.references(spark, sf))
    m = mz.single_residue_mutants(wt)
    return m.select("mutant", F.col("pos").cast("bigint"), "mt", "mutant_sequence")


@query("site_profile", ("A23", "J6"), q.with_ctes(q.RESIDUES, q.ALPHA, q.profile(), body="""
SELECT CAST(pos AS BIGINT) AS pos, aa, round(log_prob, 6) AS log_prob FROM profile"""))
def site_profile_q(spark, sf):
    p = ctx.site_profile(ctx.counted_residues(t.seqs(spark, sf)))
    return p.select(F.col("pos").cast("bigint"), "aa", F.round("log_prob", R).alias("log_prob"))


@query("position_log_softmax", ("A17",), q.with_ctes(q.RESIDUES, q.ALPHA, q.profile(), body=""",
c AS (SELECT g.pos, g.aa, CAST(coalesce(k.n, 0) AS DOUBLE) / 4.0 AS logit
      FROM profile_grid g LEFT JOIN profile_counts k ON g.pos = k.pos AND g.aa = k.aa),
cm AS (SELECT *, max(logit) OVER (PARTITION BY pos) AS m FROM c)
SELECT CAST(pos AS BIGINT) AS pos, aa,
  round(logit - m - ln(sum(exp(logit - m)) OVER (PARTITION BY pos)), 6) + 0.0 AS log_prob
FROM cm"""))
def position_log_softmax(spark, sf):
    """Residue counts / 4 used as logits, normalised per position."""
    res = t.residues(spark, sf)
    counts = res.groupBy("pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    grid = ctx.with_alphabet(res.select("pos").distinct())
    g = grid.join(counts, ["pos", "aa"], "left").select(
        "pos", "aa", (F.coalesce("n", F.lit(0)).cast("double") / 4.0).alias("logit"))
    ls = ctx.log_softmax(g, ["pos"], "logit")
    return ls.select(F.col("pos").cast("bigint"), "aa", (F.round("log_prob", R) + 0.0).alias("log_prob"))


def ctx_ctes(src: str = "residues", p: str = "") -> list[str]:
    """K5 context model over a (seq_id, pos, aa) CTE; names prefixed by ``p``."""
    return [
        f"""{p}sites AS (SELECT seq_id, pos, aa, coalesce(lag(aa) OVER o, '^') AS prev_aa, coalesce(lead(aa) OVER o, '$') AS next_aa
   FROM {src} WINDOW o AS (PARTITION BY seq_id ORDER BY pos))""",
        "lefts AS (SELECT unnest(string_split('^ACDEFGHIKLMNPQRSTVWY', '')) AS prev_aa)",
        "rights AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY$', '')) AS next_aa)",
        f"""{p}tri AS (SELECT prev_aa, next_aa, aa, count(*) AS n FROM {p}sites GROUP BY prev_aa, next_aa, aa)""",
        f"""{p}bgc AS (SELECT a.aa, coalesce(c.n, 0) AS n_aa FROM alpha a LEFT JOIN
   (SELECT aa, count(*) AS n FROM {p}sites GROUP BY aa) c ON a.aa = c.aa)""",
        f"""{p}bgp AS (SELECT aa, (n_aa + 1.0) / (sum(n_aa) OVER () + 20.0) AS p_bg FROM {p}bgc)""",
        """cgrid AS (SELECT l.prev_aa, r.next_aa, a.aa FROM lefts l CROSS JOIN rights r CROSS JOIN alpha a)""",
        f"""{p}model AS (SELECT g.prev_aa, g.next_aa, g.aa,
   ln((coalesce(t.n, 0) + 20.0 * b.p_bg) / (sum(coalesce(t.n, 0)) OVER (PARTITION BY g.prev_aa, g.next_aa) + 20.0)) AS log_prob
   FROM cgrid g LEFT JOIN {p}tri t ON g.prev_aa = t.prev_aa AND g.next_aa = t.next_aa AND g.aa = t.aa
   JOIN {p}bgp b ON b.aa = g.aa)""",
    ]


CTX_CTES = ctx_ctes()


@query("context_model", ("K5",), q.with_ctes(q.RESIDUES, q.ALPHA, CTX_CTES, body="""
SELECT prev_aa, next_aa, aa, round(log_prob, 6) AS log_prob FROM model"""))
def context_model_q(spark, sf):
    m = ctx.context_model_fit(t.seqs(spark, sf))
    return m.select("prev_aa", "next_aa", "aa", F.round("log_prob", R).alias("log_prob"))


@query("masked_marginals", ("Z4", "Z7"), q.with_ctes(q.RESIDUES, q.ALPHA, CTX_CTES, q.WT, q.SINGLE_MUTATIONS, body=""",
wsites AS (SELECT pos, CASE WHEN pos = 1 THEN '^' ELSE substr(wt_sequence, pos - 1, 1) END AS prev_aa,
   CASE WHEN pos = length(wt_sequence) THEN '$' ELSE substr(wt_sequence, pos + 1, 1) END AS next_aa FROM wt_pos),
lp AS (SELECT w.pos, m.aa, m.log_prob FROM wsites w JOIN model m ON m.prev_aa = w.prev_aa AND m.next_aa = w.next_aa)
SELECT mu.mutant, CAST(mu.pos AS BIGINT) AS pos, round(a.log_prob - b.log_prob, 6) AS score
FROM muts mu JOIN lp a ON a.pos = mu.pos AND a.aa = mu.mt JOIN lp b ON b.pos = mu.pos AND b.aa = mu.wt"""))
def masked_marginals(spark, sf):
    """Each wild-type position masked in turn and scored by the context model."""
    s = t.seqs(spark, sf)
    wt = t.wild_type(t.references(spark, sf))
    model = ctx.context_model_fit(s)
    scored = mz.zero_shot(mz.single_mutations(wt), wt, "masked-marginals", context_model=model)
    return scored.select("mutant", F.col("pos").cast("bigint"), F.round("score", R).alias("score"))


@query("pseudo_ppl_scores", ("Z5", "A16", "X10"), q.with_ctes(q.RESIDUES, q.ALPHA, CTX_CTES, q.WT, q.SINGLE_MUTATIONS, body=""",
ms AS (SELECT mu.mutant, substr(w.wt_sequence, 1, mu.pos - 1) || mu.mt || substr(w.wt_sequence, mu.pos + 1) AS s
       FROM muts mu CROSS JOIN wt w),
mp AS (SELECT mutant, s, unnest(generate_series(1, length(s))) AS i FROM ms),
mx AS (SELECT mutant, CASE WHEN i = 1 THEN '^' ELSE substr(s, i - 1, 1) END AS prev_aa, substr(s, i, 1) AS aa,
              CASE WHEN i = length(s) THEN '$' ELSE substr(s, i + 1, 1) END AS next_aa FROM mp)
SELECT mx.mutant, round(sum(m.log_prob), 6) AS score
FROM mx JOIN model m ON m.prev_aa = mx.prev_aa AND m.aa = mx.aa AND m.next_aa = mx.next_aa
GROUP BY mx.mutant"""))
def pseudo_ppl_scores(spark, sf):
    """Sum over all positions of log p(residue | neighbours) of each mutant
    sequence (delta form: only three sites differ from the wild type)."""
    s = t.seqs(spark, sf)
    wt = t.wild_type(t.references(spark, sf))
    model = ctx.context_model_fit(s)
    scored = mz.zero_shot(mz.single_mutations(wt).select("mutant", "wt", "pos", "mt"), wt, "pseudo-ppl",
                          context_model=model)
    return scored.select("mutant", F.round("score", R).alias("score"))


MSA_SQL = q.with_ctes(q.RESIDUES, q.ALPHA, q.WT, q.SINGLE_MUTATIONS, [
    "every AS MATERIALIZED (SELECT pos, aa, count(*) AS n FROM residues GROUP BY pos, aa)",
    "own AS (SELECT pos, aa, count(*) AS n FROM residues WHERE seq_id = (SELECT min(seq_id) FROM seqs) GROUP BY pos, aa)",
    "others AS (SELECT e.pos, e.aa, e.n - coalesce(o.n, 0) AS n FROM every e LEFT JOIN own o USING (pos, aa))",
], q.profile_of_counts("others", "mprof"), body="""
SELECT mu.mutant, CAST(mu.pos AS BIGINT) AS pos, round(a.log_prob - b.log_prob, 6) AS score
FROM muts mu JOIN mprof a ON a.pos = mu.pos AND a.aa = mu.mt JOIN mprof b ON b.pos = mu.pos AND b.aa = mu.wt""")


@query("msa_marginals", ("Z6", "Z7"), MSA_SQL)
def msa_marginals(spark, sf):
    """Profile of all records with the first one (the alignment's query) left
    out of its own columns; every single mutant of the wild type scored
    against it."""
    s = t.seqs(spark, sf)
    wt = t.wild_type(t.references(spark, sf))
    first = s.agg(F.min("seq_id").alias("seq_id"))
    lp = mz.msa_log_probs(ctx.counted_residues(s), ctx.counted_residues(s.join(F.broadcast(first), "seq_id", "left_semi")))
    scored = mz.zero_shot(mz.single_mutations(wt), wt, "msa", profile=lp)
    return scored.select("mutant", F.col("pos").cast("bigint"), F.round("score", R).alias("score"))


OFFSET = 24

MUTLIST_SQL = q.with_ctes(q.RESIDUES, q.ALPHA, q.profile(), q.WT, body=f""",
fwd AS (SELECT DISTINCT w.wt || CAST(r.pos + {OFFSET - 1} AS VARCHAR) || r.aa AS mutant
        FROM profile_all r JOIN wt_res w ON w.pos = r.pos
        WHERE r.aa <> w.wt),
rev AS (SELECT DISTINCT r.aa || CAST(r.pos + {OFFSET - 1} AS VARCHAR) || w.wt AS mutant
        FROM profile_all r JOIN wt_res w ON w.pos = r.pos
        WHERE r.aa <> w.wt),
lst AS (SELECT mutant FROM fwd UNION SELECT mutant FROM rev),
parsed AS (SELECT mutant, substr(mutant, 1, 1) AS wt,
                  CAST(substr(mutant, 2, length(mutant) - 2) AS INTEGER) - {OFFSET - 1} AS pos,
                  right(mutant, 1) AS mt FROM lst)
SELECT p.mutant, CAST(p.pos AS BIGINT) AS pos, coalesce(w.wt = p.wt, false) AS wt_ok,
       round(a.log_prob - b.log_prob, 6) AS score
FROM parsed p LEFT JOIN wt_res w ON w.pos = p.pos
  JOIN profile a ON a.pos = p.pos AND a.aa = p.mt JOIN profile b ON b.pos = p.pos AND b.aa = p.wt""")


def _homolog_mutation_list(counts, wt_res):
    """Codes of every (pos, letter) where some homolog differs from the wild
    type (forward: wt->homolog) plus the reversed codes (stated wt is wrong).
    Read off the residue count table: a letter other than the wild-type one
    seen at a position can only come from a homolog."""
    d = counts.join(F.broadcast(wt_res), "pos").where(F.col("aa") != F.col("wt"))
    number = F.col("pos") + F.lit(OFFSET - 1)
    fwd = d.select(F.concat("wt", number.cast("string"), "aa").alias("mutant"))
    rev = d.select(F.concat("aa", number.cast("string"), "wt").alias("mutant"))
    return fwd.union(rev).distinct(), fwd


@query("score_mutation_list", ("Z8", "X8", "P13", "J5"), MUTLIST_SQL)
def score_mutation_list(spark, sf):
    """Score a mutation list numbered from offset 24 (parse, check the stated
    wild-type residue, score against the site profile)."""
    prof, wt_res, counts = _profile_and_reference(spark, sf)
    lst, _ = _homolog_mutation_list(counts, wt_res)
    parsed = mz.parse_mutations(lst, "mutant", offset=OFFSET)
    checked = mz.check_wild_type(parsed, None, on_mismatch="flag", wt_res=wt_res)
    scored = mz.score_mutations(checked, prof)
    return scored.select("mutant", F.col("pos").cast("bigint"), "wt_ok", F.round("score", R).alias("score"))


HEAT_START, HEAT_END = OFFSET + 4, OFFSET + 19

HEATMAP_SQL = q.with_ctes(q.RESIDUES, q.ALPHA, q.profile(), q.WT, body=f""",
fwd AS (SELECT DISTINCT w.wt || CAST(r.pos + {OFFSET - 1} AS VARCHAR) || r.aa AS mutant, r.pos, w.wt, r.aa AS mt
        FROM profile_all r JOIN wt_res w ON w.pos = r.pos
        WHERE r.aa <> w.wt),
sc AS (SELECT f.mutant, min(a.log_prob - b.log_prob) AS score FROM fwd f
       JOIN profile a ON a.pos = f.pos AND a.aa = f.mt JOIN profile b ON b.pos = f.pos AND b.aa = f.wt GROUP BY f.mutant),
grid AS (SELECT a.aa, w.pos + {OFFSET - 1} AS number, w.wt || CAST(w.pos + {OFFSET - 1} AS VARCHAR) || a.aa AS mutant
         FROM wt_res w CROSS JOIN alpha a WHERE w.pos + {OFFSET - 1} BETWEEN {HEAT_START} AND {HEAT_END})
SELECT g.aa, CAST(g.number AS BIGINT) AS number, g.mutant,
       coalesce(round(s.score, 6), 'nan'::DOUBLE) AS score
FROM grid g LEFT JOIN sc s USING (mutant)""")


@query("heatmap_grid", ("Z10", "J7", "P15"), HEATMAP_SQL)
def heatmap_grid_q(spark, sf):
    """20 x window grid of the homolog mutation scores, NaN where a code was
    not in the list (window 28..43 inclusive, codes numbered from 24)."""
    prof, wt_res, counts = _profile_and_reference(spark, sf)
    _, fwd = _homolog_mutation_list(counts, wt_res)
    scored = mz.score_mutations(mz.parse_mutations(fwd, offset=OFFSET), prof)
    g = mz.heatmap_grid(scored, None, HEAT_START, HEAT_END, offset=OFFSET, wt_res=wt_res)
    return g.select("aa", F.col("number").cast("bigint"), "mutant",
                    F.when(F.isnan("score"), F.col("score")).otherwise(F.round("score", R)).alias("score"))


MANY_SQL = q.with_ctes(q.RESIDUES, q.ALPHA, CTX_CTES, q.REFS, body=""",
prot AS (SELECT seq_id AS protein, sequence, row_number() OVER (ORDER BY seq_id) - 1 AS place, count(*) OVER () AS n_proteins FROM refs),
wtr AS (SELECT protein, place, n_proteins, sequence, CAST(i AS INTEGER) AS pos, substr(sequence, i, 1) AS wt
        FROM (SELECT *, unnest(generate_series(1, length(sequence))) AS i FROM prot)),
fam AS MATERIALIZED (SELECT p.protein, r.pos, r.aa, count(*) AS n, count(*) FILTER (WHERE r.seq_id = f.first_id) AS n_own
        FROM residues r JOIN prot p ON p.place = r.seq_id % p.n_proteins
        JOIN (SELECT seq_id % (SELECT count(*) FROM refs) AS place, min(seq_id) AS first_id FROM seqs GROUP BY 1) f ON f.place = p.place
        GROUP BY p.protein, r.pos, r.aa),
kgrid AS (SELECT f.protein, f.pos, a.aa FROM (SELECT DISTINCT protein, pos FROM fam) f CROSS JOIN alpha a),
kprof AS (SELECT g.protein, g.pos, g.aa,
   ln((coalesce(f.n, 0) + 1.0) / (sum(coalesce(f.n, 0)) OVER o + 20.0)) AS lp,
   ln((coalesce(f.n - f.n_own, 0) + 1.0) / (sum(coalesce(f.n - f.n_own, 0)) OVER o + 20.0)) AS lp_msa
   FROM kgrid g LEFT JOIN fam f USING (protein, pos, aa) WINDOW o AS (PARTITION BY g.protein, g.pos)),
mu AS (SELECT w.protein, w.wt || CAST(w.pos AS VARCHAR) || 'A' AS mutant, w.pos, w.wt, 'A' AS mt, w.sequence FROM wtr w),
ctxs AS (SELECT protein, pos, CASE WHEN pos = 1 THEN '^' ELSE substr(sequence, pos - 1, 1) END AS prev_aa,
   CASE WHEN pos = length(sequence) THEN '$' ELSE substr(sequence, pos + 1, 1) END AS next_aa FROM wtr),
mlp AS (SELECT c.protein, c.pos, m.aa, m.log_prob FROM ctxs c JOIN model m USING (prev_aa, next_aa)),
ms AS (SELECT protein, mutant, substr(sequence, 1, pos - 1) || mt || substr(sequence, pos + 1) AS s FROM mu),
mx AS (SELECT protein, mutant, CASE WHEN i = 1 THEN '^' ELSE substr(s, i - 1, 1) END AS prev_aa, substr(s, i, 1) AS aa,
   CASE WHEN i = length(s) THEN '$' ELSE substr(s, i + 1, 1) END AS next_aa FROM (SELECT *, unnest(generate_series(1, length(s))) AS i FROM ms)),
ppl AS (SELECT protein, mutant, sum(m.log_prob) AS score FROM mx JOIN model m USING (prev_aa, aa, next_aa) GROUP BY protein, mutant)
SELECT CAST(mu.protein AS BIGINT) AS protein, mu.mutant, round(a.lp - b.lp, 6) + 0.0 AS wt_marginal, round(a.lp_msa - b.lp_msa, 6) + 0.0 AS msa,
  round(ma.log_prob - mb.log_prob, 6) + 0.0 AS masked_marginal, round(p.score, 5) AS pseudo_ppl
FROM mu LEFT JOIN kprof a ON a.protein = mu.protein AND a.pos = mu.pos AND a.aa = mu.mt
  LEFT JOIN kprof b ON b.protein = mu.protein AND b.pos = mu.pos AND b.aa = mu.wt
  LEFT JOIN mlp ma ON ma.protein = mu.protein AND ma.pos = mu.pos AND ma.aa = mu.mt
  LEFT JOIN mlp mb ON mb.protein = mu.protein AND mb.pos = mu.pos AND mb.aa = mu.wt
  LEFT JOIN ppl p ON p.protein = mu.protein AND p.mutant = mu.mutant""")


@query("many_proteins", ("Z3", "Z4", "Z5", "Z6", "Z7", "J5", "A23"), MANY_SQL)
def many_proteins(spark, sf):
    """The alanine scan of every reference protein by all four strategies, keyed by protein. Each protein's family is a share of the
    documents' sequences (dealt by id), the lowest id being left out of the alignment's counts; the context model is shared."""
    refs = t.references(spark, sf).select(F.col("seq_id").alias("protein"), F.col("sequence").alias("wt_sequence"))
    places = row_number_by(refs.select("protein"), ["protein"], out="rn", with_total="n")
    s = t.seqs(spark, sf)
    dealt = rel.attach_row(s, places.agg(F.max("n").alias("_n"))).withColumn("place", F.col("seq_id") % F.col("_n")).drop("_n")
    fam = dealt.join(checked_broadcast(places.select("protein", (F.col("rn") - 1).alias("place"))), "place").select("protein", "seq_id", "sequence")
    # only the first rows' sequences are read, and none is sorted; rows that share the lowest id are few
    lowest = cut_lineage(fam.groupBy("protein").agg(F.min("seq_id").alias("seq_id")))
    small = checked_broadcast(lowest)
    first = s.join(small.select("seq_id"), "seq_id", "left_semi").join(small, "seq_id").groupBy("protein").agg(F.min_by("sequence", "seq_id").alias("sequence"))

    key = ["protein"]
    wt_res = mz.wt_residues(refs, key)
    counts = ctx.residue_counts(ctx.counted_residues(fam, key), key)
    # the profiles are made for the columns their wild types have; no mutation is scored elsewhere
    counts = cut_lineage(counts.join(checked_broadcast(wt_res.select(*key, "pos").distinct()), [*key, "pos"], "left_semi"))
    own = ctx.residue_counts(ctx.counted_residues(first, key), key).withColumnRenamed("n", "n_own")
    others = counts.join(own, ["protein", "pos", "aa"], "left").withColumn("n", F.col("n") - F.coalesce("n_own", F.lit(0))).drop("n_own")
    model = ctx.context_model_fit(s)
    muts = mz.mutations_of_residues(wt_res, key, "A")
    x = mz.zero_shot(muts, refs, "wt-marginals", profile=ctx.site_profile_from_counts(counts, key=key), out="wt_marginal", key=key)
    x = mz.zero_shot(x, refs, "msa", profile=ctx.site_profile_from_counts(others, key=key), out="msa", key=key)
    x = mz.zero_shot(x, refs, "masked-marginals", context_model=model, out="masked_marginal", key=key)
    x = mz.zero_shot(x, refs, "pseudo-ppl", context_model=model, out="pseudo_ppl", key=key)
    return x.select(F.col("protein").cast("bigint"), "mutant", *[(F.round(c, R) + 0.0).alias(c) for c in ("wt_marginal", "msa", "masked_marginal")],
                    F.round("pseudo_ppl", 5).alias("pseudo_ppl"))


K6_SQL = q.with_ctes(q.RESIDUES, q.TVT, q.ALPHA, [
    "tr_pos AS (SELECT r.* FROM residues r JOIN tvt USING (seq_id) WHERE split = 'train')",
], ctx_ctes("tr_pos"), [
    "te_pos AS (SELECT r.* FROM residues r JOIN tvt USING (seq_id) WHERE split = 'test')",
    f"""u AS (SELECT seq_id, pos, aa,
        {stable_hash_sql('42:pick', 'seq_id', 'pos')} / 4294967296.0 AS u1,
        {stable_hash_sql('42:kind', 'seq_id', 'pos')} / 4294967296.0 AS u2,
        substr('ACDEFGHIKLMNPQRSTVWY', CAST({stable_hash_sql('42:rand', 'seq_id', 'pos')} % 20 + 1 AS INTEGER), 1) AS rnd
      FROM te_pos)""",
    """mk AS (SELECT seq_id, pos, aa,
        CASE WHEN u1 >= 0.15 THEN aa WHEN u2 < 0.8 THEN '#' WHEN u2 < 0.9 THEN rnd ELSE aa END AS input,
        CASE WHEN u1 < 0.15 THEN aa END AS label FROM u)""",
    """ms AS (SELECT *, coalesce(lag(input) OVER (PARTITION BY seq_id ORDER BY pos), '^') AS prev_aa,
               coalesce(lead(input) OVER (PARTITION BY seq_id ORDER BY pos), '$') AS next_aa FROM mk)""",
    "st AS (SELECT * FROM ms WHERE label IS NOT NULL)",
    """best AS (SELECT prev_aa, next_aa, aa AS pred FROM
        (SELECT *, row_number() OVER (PARTITION BY prev_aa, next_aa ORDER BY log_prob DESC, aa) AS k FROM model) WHERE k = 1)""",
    "bg AS (SELECT aa, log_prob FROM model WHERE prev_aa = '^' AND next_aa = '$')",
    "bgbest AS (SELECT aa AS pred FROM bg ORDER BY log_prob DESC, aa LIMIT 1)",
    """cp AS (SELECT s.label, coalesce(m.log_prob, b.log_prob) AS lp, coalesce(bs.pred, (SELECT pred FROM bgbest)) AS pred
        FROM st s LEFT JOIN model m ON m.prev_aa = s.prev_aa AND m.next_aa = s.next_aa AND m.aa = s.label
        LEFT JOIN best bs ON bs.prev_aa = s.prev_aa AND bs.next_aa = s.next_aa
        LEFT JOIN bg b ON b.aa = s.label)""",
    """bp AS (SELECT s.label, b.log_prob AS lp, (SELECT pred FROM bgbest) AS pred FROM st s LEFT JOIN bg b ON b.aa = s.label)""",
], body="""
SELECT 'context' AS model, count(*) AS n_sites, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(exp(avg(-lp)), 6) AS perplexity FROM cp
UNION ALL
SELECT 'background', count(*), round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6), round(exp(avg(-lp)), 6) FROM bp""")


@query("context_model_eval", ("K6", "K3", "A11", "A15", "A22", "W3"), K6_SQL)
def context_model_eval(spark, sf):
    """Fit the neighbour-context model on the train split; masked-residue
    accuracy and perplexity on the test split, against its no-context form."""
    # the split table feeds both the fit and the evaluation: one pass over
    # the documents, written to the shared checkpoint folder
    s = cut_lineage(sp.train_valid_test(t.seqs(spark, sf), "seq_id"))
    model = ctx.context_model_fit(sp.filter_split(s, "train"))
    ev = ctx.context_model_eval(sp.filter_split(s, "test"), model)
    return ev.select("model", "n_sites", F.round("accuracy", R).alias("accuracy"),
                     F.round("perplexity", R).alias("perplexity"))
