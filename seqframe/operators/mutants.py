"""Mutation scanning and zero-shot scoring.

A model enters as a log-probability table ``(key..., pos, aa, log_prob)``
(from ``site_profile``, the context model, or any user model). The score of a
mutation wt->mt at pos is log p(mt) - log p(wt) at that position. The model
table is folded into one map per position first, so scoring is a single
equi-join on (key, pos) whose build side has L rows per protein.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.sequences import ALPHABET, apply_mutation, format_mutation, parse_mutation
from seqframe.operators.context import neighbour_sites, site_log_prob, site_profile, with_alphabet, with_context
from seqframe.operators.ranking import attach_values
from seqframe.operators.relational import attach_row
from seqframe.session import bounded_broadcast, cut_lineage

STRATEGIES = ("wt-marginals", "masked-marginals", "pseudo-ppl", "msa")


def wt_residues(wt: DataFrame, key: list[str] | tuple = (), seq: str = "wt_sequence") -> DataFrame:
    """(key..., pos, wt) from a wild-type table (one row per protein)."""
    key = list(key)
    return (wt.select(*key, F.posexplode(F.split(seq, "")).alias("p", "wt"))
            .select(*key, (F.col("p") + 1).cast("int").alias("pos"), "wt"))


def single_mutations(wt: DataFrame, key: list[str] | tuple = (), seq: str = "wt_sequence",
                     alphabet: str = ALPHABET, offset: int = 1) -> DataFrame:
    """Every position x every letter (wt->wt included), code numbered
    from ``offset``. Columns: key..., mutant, wt, pos, mt."""
    return mutations_of_residues(wt_residues(wt, key, seq), key, alphabet, offset)


def mutations_of_residues(wt_res: DataFrame, key: list[str] | tuple = (), alphabet: str = ALPHABET,
                          offset: int = 1) -> DataFrame:
    """Z1 from a (key..., pos, wt) residue table of the wild type."""
    key = list(key)
    grid = with_alphabet(wt_res, alphabet, "mt")  # J6
    number = F.col("pos") + F.lit(offset - 1)
    return grid.select(*key, format_mutation("wt", number, "mt").alias("mutant"), "wt", "pos", "mt")


def single_residue_mutants(wt: DataFrame, key: list[str] | tuple = (), seq: str = "wt_sequence",
                           alphabet: str = ALPHABET) -> DataFrame:
    """19 x L full mutant sequences (wt->wt excluded)."""
    key = list(key)
    m = single_mutations(wt, key, seq, alphabet).where(F.col("wt") != F.col("mt"))
    # one wild-type row per protein: joined on the key, or broadcast when single
    m = m.join(wt.select(*key, seq), key) if key else attach_row(m, wt.select(seq))
    return m.select(*key, "mutant", "pos", "mt",
                    apply_mutation(seq, "pos", "mt").alias("mutant_sequence"))


def parse_mutations(muts: DataFrame, col: str = "mutant", offset: int = 1) -> DataFrame:
    """X8 on a table: adds wt, pos (1-based into the wild type), mt."""
    p = parse_mutation(col, offset)
    return muts.withColumn("_m", p).select("*", "_m.wt", "_m.pos", "_m.mt").drop("_m")


def check_wild_type(muts: DataFrame, wt: DataFrame | None, key: list[str] | tuple = (),
                    seq: str = "wt_sequence", on_mismatch: str = "flag",
                    wt_res: DataFrame | None = None) -> DataFrame:
    """Does the stated wt residue equal the wild type at pos?

    ``flag`` adds ``wt_ok``; ``drop`` keeps matching rows; ``error`` raises
    when any row mismatches (one count, no rows fetched). The wild type is a
    sequence table ``wt`` or its residue table ``wt_res`` (key..., pos, wt).
    """
    key = list(key)
    ref = (wt_res if wt_res is not None else wt_residues(wt, key, seq)).withColumnRenamed("wt", "_wt_ref")
    ok = F.coalesce(F.col("_wt_ref") == F.col("wt"), F.lit(False))
    x = muts.join(ref, [*key, "pos"], "left").withColumn("wt_ok", ok).drop("_wt_ref")
    if on_mismatch == "flag":
        return x
    if on_mismatch == "drop":
        return x.where("wt_ok").drop("wt_ok")
    if on_mismatch == "error":
        bad = x.where(~F.col("wt_ok")).limit(1).count()
        if bad:
            raise ValueError("mutation list does not match the wild type")
        return x.drop("wt_ok")
    raise ValueError("on_mismatch must be flag, drop or error")


def position_maps(log_probs: DataFrame, key: list[str] | tuple = ()) -> DataFrame:
    """(key..., pos, lp map<aa, log_prob>): one row per position."""
    key = list(key)
    return log_probs.groupBy(*key, "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("aa", "log_prob"))).alias("lp"))


def score_mutations(muts: DataFrame, log_probs: DataFrame, key: list[str] | tuple = (),
                    out: str = "score", bound_rows: int | None = None) -> DataFrame:
    """score = log p(mt) - log p(wt) at pos (wt->wt scores 0).

    ``bound_rows``: number of positions when known (one wild type) - the map
    table is then broadcast; otherwise AQE chooses from runtime sizes.
    """
    key = list(key)
    maps = position_maps(log_probs, key)
    if bound_rows is not None:
        maps = bounded_broadcast(maps, bound_rows)
    s = F.element_at("lp", F.col("mt")) - F.element_at("lp", F.col("wt"))
    return muts.join(maps, [*key, "pos"], "left").withColumn(out, s).drop("lp")


def masked_log_probs(wt: DataFrame, model: DataFrame, key: list[str] | tuple = (),
                     seq: str = "wt_sequence") -> DataFrame:
    """Z4 model side: for each wild-type position masked in turn, the
    context model's log p(aa | wt neighbours), the background's where a neighbour is a letter
    the model lacks. Returns (key..., pos, aa, log_prob)."""
    key = list(key)
    x = with_context(neighbour_sites(wt, key, seq).drop("aa"), model)
    return x.select(*key, "pos", F.explode(F.coalesce("lp", "bg")).alias("aa", "log_prob"))


def pseudo_ppl(muts: DataFrame, wt: DataFrame, model: DataFrame, out: str = "score",
               seq: str = "wt_sequence", key: list[str] | tuple = ()) -> DataFrame:
    """Per mutant, sum over all positions of log p(residue | neighbours)
    of the mutant sequence (A16). Only sites pos-1, pos, pos+1 differ from
    the wild type, so: wild-type total + the three site deltas.

    With ``key`` both tables hold many proteins; sites are matched on (key,
    pos), so a protein with most of the mutations is spread over its
    positions. A neighbour the model lacks gives the background's log p; a site whose own letter it
    lacks counts 0. Distinct mutations are scored once and joined back; one
    outside the wild type or to a letter the model lacks scores null."""
    key = list(key)
    given = muts
    muts = given.select(*key, "pos", "wt", "mt").distinct()
    lp = F.coalesce(site_log_prob(F.col("aa")), F.lit(0.0))
    wsc = with_context(neighbour_sites(wt, key, seq), model).select(*key, "pos", "prev_aa", "aa", "next_aa", lp.alias("lp_wt"))
    total = wsc.groupBy(*key).agg(F.sum("lp_wt").alias("wt_total")) if key else wsc.agg(F.sum("lp_wt").alias("wt_total"))
    # affected sites of each mutant, with the mutated triple
    d = muts.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_d"))
    d = d.withColumn("_site", F.col("pos") + F.col("_d")).join(wsc.withColumnRenamed("pos", "_site"), [*key, "_site"])
    at = F.col("_d")
    d = d.select(*key, "pos", "wt", "mt", "_d", "lp_wt", F.when(at == 1, F.col("mt")).otherwise(F.col("prev_aa")).alias("prev_aa"),
                 F.when(at == 0, F.col("mt")).otherwise(F.col("aa")).alias("aa"),
                 F.when(at == -1, F.col("mt")).otherwise(F.col("next_aa")).alias("next_aa"))
    own = site_log_prob(F.col("aa"))
    d = with_context(d, model)
    delta = d.groupBy(*key, "pos", "wt", "mt").agg(
        F.sum(F.coalesce(own, F.lit(0.0)) - F.col("lp_wt")).alias("_delta"),
        F.max(F.when((F.col("_d") == 0) & own.isNotNull(), 1)).alias("_own")).where("_own = 1").drop("_own")
    if key:
        total = cut_lineage(total)  # one row a protein
        scored = attach_values(delta, total, key, [], total.count())
    else:
        scored = attach_row(delta, total)
    scored = scored.select(*key, "pos", "wt", "mt", (F.col("wt_total") + F.col("_delta")).alias(out))
    return given.join(scored, [*key, "pos", "wt", "mt"], "left").select(*given.columns, out)


def msa_log_probs(aligned_residues: DataFrame, query_residues: DataFrame, alphabet: str = ALPHABET,
                  pseudocount: float = 1.0, key: list[str] | tuple = ()) -> DataFrame:
    """Z6 model side: site profile of the alignment with the query sequence
    left out of its own column counts, per protein with ``key``."""
    return site_profile(aligned_residues, alphabet, pseudocount, key, exclude=query_residues)


def zero_shot(muts: DataFrame, wt: DataFrame, strategy: str, *, profile: DataFrame | None = None,
              context_model: DataFrame | None = None, out: str = "score",
              seq: str = "wt_sequence", key: list[str] | tuple = ()) -> DataFrame:
    """Dispatch on scoring strategy; unknown strategy raises. With ``key``
    mutations, wild types and profile hold many proteins; the context model is shared."""
    if strategy == "wt-marginals" or strategy == "msa":
        if profile is None:
            raise ValueError(f"strategy {strategy} needs a profile table")
        return score_mutations(muts, profile, key, out=out)
    if strategy == "masked-marginals":
        if context_model is None:
            raise ValueError("masked-marginals needs a context model")
        return score_mutations(muts, masked_log_probs(wt, context_model, key, seq), key, out=out)
    if strategy == "pseudo-ppl":
        if context_model is None:
            raise ValueError("pseudo-ppl needs a context model")
        return pseudo_ppl(muts, wt, context_model, out, seq, key)
    raise ValueError(f"unknown scoring strategy {strategy!r}; expected one of {STRATEGIES}")


def wt_marginals(muts: DataFrame, log_probs: DataFrame, out: str = "score", key: list[str] | tuple = ()) -> DataFrame:
    """Z3: log p(mt) - log p(wt) under unmasked per-position log-probabilities
    (a site profile, or any model's (key..., pos, aa, log_prob) table)."""
    return score_mutations(muts, log_probs, key, out=out)


def masked_marginals(muts: DataFrame, wt: DataFrame, context_model: DataFrame, out: str = "score",
                     seq: str = "wt_sequence", key: list[str] | tuple = ()) -> DataFrame:
    """The same difference with each wild-type position masked in turn."""
    return zero_shot(muts, wt, "masked-marginals", context_model=context_model, out=out, seq=seq, key=key)


def msa_marginals(muts: DataFrame, aligned_residues: DataFrame, query_residues: DataFrame,
                  out: str = "score", pseudocount: float = 1.0, key: list[str] | tuple = ()) -> DataFrame:
    """Marginals from the alignment's site profile, the query sequence
    left out of its own column counts (select the alignment depth first)."""
    return score_mutations(muts, msa_log_probs(aligned_residues, query_residues, pseudocount=pseudocount, key=key), key, out=out)


def top_k(df: DataFrame, k: int, by: str, tie: list[str]) -> DataFrame:
    """K best rows by ``by`` desc, unique tie-break (TakeOrderedAndProject)."""
    return df.orderBy(F.col(by).desc(), *[F.col(t) for t in tie]).limit(k)


def heatmap_grid(scores: DataFrame, wt: DataFrame | None, start: int | None = None, end: int | None = None,
                 offset: int = 1, alphabet: str = ALPHABET, score: str = "score",
                 order: str | None = None, seq: str = "wt_sequence", wt_res: DataFrame | None = None) -> DataFrame:
    """Alphabet x [start, end] (inclusive, in code numbering) grid of
    scores for codes wt+number+aa; NaN where no score exists (J7).
    Duplicated codes keep the first row by ``order`` (min_by), else the min.
    Columns: aa, number, mutant, score."""
    res = wt_res if wt_res is not None else wt_residues(wt, (), seq)
    codes = mutations_of_residues(res, (), alphabet, offset)
    number = F.col("pos") + F.lit(offset - 1)
    if start is not None:
        codes = codes.where(number >= start)  # P15
    if end is not None:
        codes = codes.where(number <= end)
    if order:
        first = scores.groupBy("mutant").agg(F.min_by(score, order).alias("_s"))
    else:
        first = scores.groupBy("mutant").agg(F.min(score).alias("_s"))
    g = codes.join(first, "mutant", "left")
    return g.select(F.col("mt").alias("aa"), number.cast("int").alias("number"), "mutant",
                    F.coalesce(F.col("_s").cast("double"), F.lit(float("nan"))).alias(score))


def heatmap_wide(grid: DataFrame, score: str = "score", numbers: list[int] | None = None) -> DataFrame:
    """Z10 wide form: one row per residue, one column per position.

    Pass ``numbers`` (the window, e.g. ``range(start, end + 1)``) when known:
    the pivot then needs no extra job to find the distinct positions."""
    g = grid.groupBy("aa")
    p = g.pivot("number", list(numbers)) if numbers is not None else g.pivot("number")
    return p.agg(F.first(score))

