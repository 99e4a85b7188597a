"""Count-based residue models: site profiles (A23), log-softmax (A17),
neighbour-context model (K5), masking (K3, K4) and masked evaluation (K6).

Every model here is a small table whose size is fixed by the alphabet and the
sequence length (L x 20 for a profile, 21 x 21 x 20 for the context model),
so it is safe to broadcast; the data-sized input is only ever aggregated
(map-side partial counts first) or streamed past the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from seqframe.functions.hashing import stable_hash, stable_uniform
from seqframe.functions.sequences import ALPHABET
from seqframe.operators.relational import attach_row
from seqframe.session import checked_broadcast, cut_lineage, literal_table

BOS, EOS, MASK = "^", "$", "#"


def alphabet_table(spark: SparkSession, alphabet: str = ALPHABET, col: str = "aa") -> DataFrame:
    """The residue alphabet as a table (fixed 20 rows)."""
    return literal_table(spark, [(a, i) for i, a in enumerate(alphabet)], [col, "aa_index"])


def with_alphabet(df: DataFrame, alphabet: str = ALPHABET, col: str = "aa") -> DataFrame:
    """Every row x every letter, as a narrow explode of a literal array
    (no join, no shuffle; the letter list is a 20-entry constant)."""
    return df.select("*", F.explode(F.array(*[F.lit(a) for a in alphabet])).alias(col))


def log_softmax(df: DataFrame, group: list[str], score: str, out: str = "log_prob") -> DataFrame:
    """Score - max - log(sum(exp(score - max))) within each group.

    Groups are positions (or contexts) of a model table: bounded size.
    """
    w = Window.partitionBy(*group)
    m = F.max(score).over(w)
    lse = m + F.log(F.sum(F.exp(F.col(score) - m)).over(w))
    return df.withColumn(out, F.col(score) - lse)


def residue_counts(residues: DataFrame, key: list[str] | tuple = (), id_col: str | None = None) -> DataFrame:
    """(key..., pos, aa, n[, first_id]): one aggregation over the residue
    table (map-side partial counts; the result has at most L x |letters|
    rows per protein). ``first_id`` = lowest ``id_col`` holding that letter,
    which identifies the reference (lowest-id) sequence's residues.
    Rows of ``counted_residues`` count ``n`` times."""
    key = list(key)
    aggs = [(F.sum("n") if "n" in residues.columns else F.count(F.lit(1))).alias("n")]
    if id_col:
        aggs.append(F.min(id_col).alias("first_id"))
    return residues.groupBy(*key, "pos", "aa").agg(*aggs)


#: Sites whose contexts are counted at a time.
_SITES = 1 << 18
#: Letters that are counted in arrays, by places of a run of ``_RUN``; at most ``_CELLS`` counts are held at a time.
_COUNTED, _RUN, _CELLS = ALPHABET + "BJOUXZ-.*", 512, 1 << 24


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of an array of strings end to end, as code points, and where each string begins (and the last ends)."""
    column = pc.fill_null(column, "").cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    if not len(data) or data.max() < 128:
        return data, offsets - offsets[0]
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), np.r_[0, np.cumsum(lengths)].astype(np.int64)


def counted_residues(df: DataFrame, key: list[str] | tuple = (), seq: str = "sequence") -> DataFrame:
    """(key..., pos, aa, n): all residues of the sequences of ``df``, ``pos`` from 1, for ``residue_counts``.

    Equal letters at one place of a key are counted within a task before they become rows, up to a bounded number of
    counts at a time; so a key, place and letter may have several rows. Narrow: no shuffle.
    """
    key = list(key)
    schema = StructType([StructField(k, df.schema[k].dataType) for k in key]).add("pos", IntegerType()).add("aa", StringType()).add("n", LongType())
    other, most = 31, _CELLS
    column_of = np.full(256, other, np.int64)
    column_of[[ord(a) for a in _COUNTED]] = np.arange(len(_COUNTED))
    letters = pa.array(list(_COUNTED))
    rows = np.arange(_RUN) * 32

    def count(batches):
        held: dict[tuple, np.ndarray] = {}
        single: list[tuple] = []  # other letters, one by one
        types: list[pa.DataType] = []

        def drained():
            for (k, run), counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t).take(pa.array(np.zeros(len(at), np.int64))) for v, t in zip(k, types)]
                    + [pa.array(run * _RUN + at // 32 + 1, pa.int32()), letters.take(pa.array(at % 32)), pa.array(counts[at], pa.int64())], names=schema.names)
            if single:
                columns = [list(c) for c in zip(*[(*k, pos, aa, 1) for k, pos, aa in single])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [*types, pa.int32(), pa.string(), pa.int64()])], names=schema.names)
            held.clear()
            single.clear()

        for b in batches:
            types = [b.column(i).type for i in range(len(key))]
            keys = zip(*[b.column(i).to_pylist() for i in range(len(key))]) if key else [()] * b.num_rows
            codes, offsets = _codes(b.column(len(key)))
            there = b.column(len(key)).is_valid().to_pylist()
            for k, lo, hi, is_there in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), there):
                if lo == hi and is_there:
                    single.append((k, 1, ""))  # an empty sequence has one empty residue
                for run, at in enumerate(range(lo, hi, _RUN)):
                    x = codes[at:min(at + _RUN, hi)]
                    column = column_of[np.minimum(x, 255)]
                    counts = held.get((k, run))
                    if counts is None:
                        counts = held[k, run] = np.zeros(32 * _RUN, np.int32)
                    place = np.flatnonzero(column != other)
                    if len(place) < len(x):
                        single += [(k, run * _RUN + i + 1, chr(x[i])) for i in np.flatnonzero(column == other).tolist()]
                        counts[rows[place] + column[place]] += 1
                    else:
                        counts[rows[:len(x)] + column] += 1
                    if len(held) * 32 * _RUN >= most or len(single) >= 1 << 16:
                        yield from drained()
        yield from drained()

    return df.select(*key, F.col(seq).cast("string").alias("_s")).mapInArrow(count, schema)


def counted_contexts(df: DataFrame, seq: str = "sequence", alphabet: str = ALPHABET) -> DataFrame:
    """(prev_aa, next_aa, aa, n): letters of the alphabet between their neighbours, counted within each task (ends are ^ and $,
    a neighbour that is neither an end nor of the alphabet is null). Narrow: no shuffle."""
    size = len(alphabet)
    own, left, right = (np.full(max(map(ord, alphabet + BOS + EOS)) + 2, x, np.int64) for x in (size, size + 1, size + 1))
    for x in (own, left, right):
        x[[ord(a) for a in alphabet]] = np.arange(size)
    left[ord(BOS)] = right[ord(EOS)] = size

    def count(batches):
        total = np.zeros((size + 2) ** 2 * size, np.int64)
        for b in batches:
            codes, offsets = _codes(b.column(0))
            filled = offsets[1:] > offsets[:-1]
            starts, ends = offsets[:-1][filled], offsets[1:][filled]
            for lo in range(0, len(codes), _SITES):
                hi = min(lo + _SITES, len(codes))
                x = np.minimum(codes[max(lo - 1, 0):hi + 1], len(own) - 1)
                a, z = np.full(hi - lo, size, np.int64), np.full(hi - lo, size, np.int64)
                a[lo == 0:] = left[x[:hi - max(lo, 1)]]
                z[:len(codes) - 1 - lo] = right[x[(lo > 0) + 1:]]
                a[starts[(starts >= lo) & (starts < hi)] - lo] = size
                z[ends[(ends > lo) & (ends <= hi)] - 1 - lo] = size
                aa = own[x[int(lo > 0):int(lo > 0) + hi - lo]]
                seen = aa < size
                total += np.bincount(((a * (size + 2) + z) * size + aa)[seen], minlength=len(total))
        at = np.flatnonzero(total)
        place = lambda x, end: pa.array([*alphabet, end, None], pa.string()).take(pa.array(x))
        yield pa.RecordBatch.from_arrays([place(at // size // (size + 2), BOS), place(at // size % (size + 2), EOS), place(at % size, None),
                                          pa.array(total[at], pa.int64())], names=["prev_aa", "next_aa", "aa", "n"])

    return df.select(F.col(seq).cast("string").alias("_s")).mapInArrow(count, "prev_aa string, next_aa string, aa string, n long")


def reference_from_counts(counts: DataFrame, key: list[str] | tuple = ()) -> DataFrame:
    """(key..., pos, wt): residue of the lowest-id sequence at every position,
    read off the count table (no second pass over the residues)."""
    key = list(key)
    return counts.groupBy(*key, "pos").agg(F.min_by("aa", "first_id").alias("wt"))


def site_profile_from_counts(counts: DataFrame, alphabet: str = ALPHABET, pseudocount: float = 1.0,
                             key: list[str] | tuple = ()) -> DataFrame:
    """A23 from a ``residue_counts`` table: positions x alphabet grid,
    log((n + pc) / (n(pos) + |alphabet| pc)); non-alphabet letters (gaps)
    keep their position in the grid but count towards nothing."""
    key = list(key)
    known = F.lit(True)
    for k in (*key, "pos"):
        known = known & F.col(k).isNotNull()
    n = [F.coalesce(F.sum(F.when(known & (F.col("aa") == a), F.col("n"))), F.lit(0)).alias(f"_n{i}") for i, a in enumerate(alphabet)]
    g = counts.groupBy(*key, "pos").agg(*n)  # a row a position: no grid is joined
    tot = sum((F.col(f"_n{i}") for i in range(len(alphabet))), F.lit(0))
    pc = F.lit(float(pseudocount))
    x = g.select(*key, "pos", tot.alias("_tot"), F.explode(F.array(*[F.struct(F.lit(a).alias("aa"), F.col(f"_n{i}").alias("n"))
                                                                     for i, a in enumerate(alphabet)])).alias("x"))
    return x.select(*key, "pos", "x.aa", F.log((F.col("x.n") + pc) / (F.col("_tot") + pc * F.lit(len(alphabet)))).alias("log_prob"))


def site_profile(residues: DataFrame, alphabet: str = ALPHABET, pseudocount: float = 1.0,
                 key: list[str] | tuple = (), exclude: DataFrame | None = None) -> DataFrame:
    """Position-specific log-frequencies from aligned residues.

    ``residues``: (key..., pos, aa). Returns (key..., pos, aa, log_prob) for every
    position seen and every alphabet letter:
    log((n(pos,aa) + pc) / (n(pos) + |alphabet| * pc)). Letters outside the
    alphabet (gaps) count towards nothing. ``exclude``: residues (key..., pos, aa)
    to subtract from the counts (e.g. the query sequence itself).
    One aggregation over the residues; positions come from its result.
    """
    key = list(key)
    counts = residue_counts(residues, key)
    if exclude is not None:
        ex = residue_counts(exclude, key).withColumnRenamed("n", "n_ex")
        counts = (counts.join(ex, [*key, "pos", "aa"], "left")
                  .select(*key, "pos", "aa", (F.col("n") - F.coalesce("n_ex", F.lit(0))).alias("n")))
    return site_profile_from_counts(counts, alphabet, pseudocount, key)


def neighbour_sites(df: DataFrame, key: str | list[str] | tuple = "seq_id", seq: str = "sequence") -> DataFrame:
    """(key..., pos, left, aa, right) per residue; ends padded with ^ and $.

    Letters are zipped with their neighbours before they are exploded: no
    window, no shuffle, and no row carries the whole sequence.
    """
    key = [key] if isinstance(key, str) else list(key)
    return (df.select(*key, F.posexplode(_with_neighbours(seq)).alias("p", "x"))
            .select(*key, (F.col("p") + 1).cast("int").alias("pos"), "x.prev_aa", "x.aa", "x.next_aa"))


def _with_neighbours(seq: str):
    """array<struct<aa, prev_aa, next_aa>> of a sequence."""
    a = F.split(F.col(seq), "")
    n = F.size(a)
    return F.arrays_zip(a.alias("aa"), F.concat(F.array(F.lit(BOS)), F.slice(a, F.lit(1), n - 1)).alias("prev_aa"),
                        F.concat(F.slice(a, F.lit(2), n - 1), F.array(F.lit(EOS))).alias("next_aa"))


def context_model_fit(df: DataFrame, key: str = "seq_id", seq: str = "sequence",
                      alphabet: str = ALPHABET, pseudocount: float = 1.0,
                      strength: float = 20.0) -> DataFrame:
    """K5: P(aa | left, right) with back-off to the residue background.

    P = (n(l,r,aa) + strength * P_bg(aa)) / (n(l,r) + strength), where
    P_bg(aa) = (n(aa) + pc) / (N + 20 pc). The table covers every context over
    alphabet + ends (21 x 21 x 20 rows), so unseen contexts are the background.
    Columns: left, right, aa, log_prob.
    """
    spark = df.sparkSession
    # the fit: one pass over the sites into a (21 x 21 x 20)-bounded count
    # table, checkpointed to the shared folder so both uses below read it
    tri = cut_lineage(counted_contexts(df, seq, alphabet).groupBy("prev_aa", "next_aa", "aa").agg(F.sum("n").alias("n")))
    bg = tri.groupBy("aa").agg(F.sum("n").alias("n_aa"))  # from the small table: one pass over sites
    letters = alphabet_table(spark, alphabet).drop("aa_index")
    # fixed (A+1)^2 * A grid of contexts x letters, generated without joins
    grid = with_alphabet(with_alphabet(with_alphabet(spark.range(1).drop("id"), BOS + alphabet, "prev_aa"),
                                       alphabet + EOS, "next_aa"), alphabet, "aa")
    pc = F.lit(float(pseudocount))
    bgp = (letters.join(bg, "aa", "left").withColumn("n_aa", F.coalesce("n_aa", F.lit(0)))
           .withColumn("p_bg", (F.col("n_aa") + pc) / (F.sum("n_aa").over(Window.partitionBy()) + pc * F.lit(len(alphabet))))
           .select("aa", "p_bg"))
    k = F.lit(float(strength))
    m = (grid.join(tri, ["prev_aa", "next_aa", "aa"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
         .join(F.broadcast(bgp), "aa"))
    nctx = F.sum("n").over(Window.partitionBy("prev_aa", "next_aa"))
    return m.select("prev_aa", "next_aa", "aa",
                    F.log((F.col("n") + k * F.col("p_bg")) / (nctx + k)).alias("log_prob"))


def background_model(model: DataFrame) -> DataFrame:
    """Residue log-probabilities of unseen contexts (back-off row of K5)."""
    return model.where((F.col("prev_aa") == BOS) & (F.col("next_aa") == EOS)).select("aa", "log_prob")


def _mask_rule(key: str, pos, aa, p: float, seed: int, alphabet: str, mask_token: str):
    """(chosen, input) of the residue ``aa`` at ``pos``: chosen when u1 < p;
    a chosen residue becomes the mask token when u2 < 0.8, a random residue
    when u2 < 0.9, else stays. u1, u2 and the random letter are stable hashes
    of (seed, key, pos), so any site's masked letter is computable in place."""
    u1 = stable_uniform(f"{seed}:pick", key, pos)
    u2 = stable_uniform(f"{seed}:kind", key, pos)
    rnd = F.substring(F.lit(alphabet), (stable_hash(f"{seed}:rand", key, pos) % len(alphabet) + 1).cast("int"), F.lit(1))
    chosen = u1 < F.lit(p)
    inp = (F.when(~chosen, aa)
           .when(u2 < F.lit(0.8), F.lit(mask_token))
           .when(u2 < F.lit(0.9), rnd)
           .otherwise(aa))
    return chosen, inp


def mlm_mask(df: DataFrame, key: str = "seq_id", seq: str = "sequence", p: float = 0.15,
             seed: int = 42, alphabet: str = ALPHABET, mask_token: str = MASK) -> DataFrame:
    """K3: per residue (key, pos, aa, input, label).

    ``label`` is the true residue on chosen sites and null elsewhere (the
    -100 rule); see ``_mask_rule`` for the choice and the replacement.
    """
    x = df.select(key, F.posexplode(F.split(seq, "")).alias("p", "aa")).withColumn("pos", (F.col("p") + 1).cast("int"))
    chosen, inp = _mask_rule(key, "pos", F.col("aa"), p, seed, alphabet, mask_token)
    return x.select(key, "pos", "aa", inp.alias("input"), F.when(chosen, F.col("aa")).alias("label"))


def masked_sites_of(df: DataFrame, key: str = "seq_id", seq: str = "sequence", p: float = 0.15,
                    seed: int = 42, alphabet: str = ALPHABET, mask_token: str = MASK) -> DataFrame:
    """K3 + neighbour context, narrow: the chosen sites of ``mlm_mask`` with
    the masked letters left and right of them, (key, pos, aa, input, label,
    prev_aa, next_aa). The neighbours' masked letters are recomputed from the
    sequence string and the position hash, so no window and no shuffle."""
    x = (df.select(key, F.posexplode(_with_neighbours(seq)).alias("p", "x"))
         .select(key, (F.col("p") + 1).cast("int").alias("pos"), "x.aa", F.col("x.prev_aa").alias("_l"), F.col("x.next_aa").alias("_r")))
    chosen, inp = _mask_rule(key, "pos", F.col("aa"), p, seed, alphabet, mask_token)
    x = x.where(chosen).withColumn("input", inp).withColumn("label", F.col("aa"))
    x = x.withColumn("_lp", F.col("pos") - 1).withColumn("_rp", F.col("pos") + 1)
    _, left = _mask_rule(key, "_lp", F.col("_l"), p, seed, alphabet, mask_token)
    _, right = _mask_rule(key, "_rp", F.col("_r"), p, seed, alphabet, mask_token)
    return x.select(key, "pos", "aa", "input", "label",
                    F.when(F.col("pos") == 1, F.lit(BOS)).otherwise(left).alias("prev_aa"),
                    F.when(F.col("_r") == EOS, F.lit(EOS)).otherwise(right).alias("next_aa"))


def mask_each_position(df: DataFrame, key: str = "seq_id", seq: str = "sequence",
                       mask_token: str = MASK) -> DataFrame:
    """K4: one copy of each sequence per position with that residue masked."""
    x = df.select(key, seq, F.posexplode(F.split(seq, "")).alias("p", "aa"))
    pos = (F.col("p") + 1).cast("int")
    return x.select(key, pos.alias("pos"), "aa",
                    F.overlay(F.col(seq), F.lit(mask_token), pos, F.lit(1)).alias("masked"))


def masked_sites(masked: DataFrame, key: str = "seq_id") -> DataFrame:
    """Neighbour context of each chosen site as seen in the masked input."""
    w = Window.partitionBy(key).orderBy("pos")
    # windows per sequence: one sequence is at most a few thousand residues
    x = masked.withColumn("prev_aa", F.coalesce(F.lag("input").over(w), F.lit(BOS))) \
              .withColumn("next_aa", F.coalesce(F.lead("input").over(w), F.lit(EOS)))
    return x.where(F.col("label").isNotNull())


def context_maps(model: DataFrame) -> DataFrame:
    """(prev_aa, next_aa, lp map<aa, log_prob>, pred): the model folded to one row a context.

    ``pred`` is its likeliest letter, the first of equals.
    """
    return model.groupBy("prev_aa", "next_aa").agg(
        F.map_from_entries(F.collect_list(F.struct("aa", "log_prob"))).alias("lp"),
        F.min_by("aa", F.struct(-F.col("log_prob"), F.col("aa"))).alias("pred"))


def with_context(sites: DataFrame, model: DataFrame) -> DataFrame:
    """``sites`` (.., prev_aa, next_aa) with ``lp`` and ``pred`` of their context, and ``bg`` and ``bg_pred`` of the background.

    ``lp`` is null for a context the model has no row for (a masked or
    unknown neighbour); readers then take the background. Both tables are
    as large as the alphabet squared: they are counted and broadcast, or joined if
    a user's model is larger.
    """
    maps = context_maps(model)
    bg = context_maps(background_model(model).withColumns({"prev_aa": F.lit(BOS), "next_aa": F.lit(EOS)}))
    bg = bg.agg(F.first("lp").alias("bg"), F.first("pred").alias("bg_pred"))
    return attach_row(sites.join(checked_broadcast(maps), ["prev_aa", "next_aa"], "left"), bg)


def site_log_prob(aa: Column, lp: str = "lp", bg: str = "bg") -> Column:
    """log p(aa) in the site's context, by the background where the context is unknown; null for a letter the model lacks."""
    return F.coalesce(F.try_element_at(F.col(lp), aa), F.try_element_at(F.col(bg), aa))


def predict_sites(sites: DataFrame, model: DataFrame) -> DataFrame:
    """Join chosen sites with the model: log p(true residue) and argmax.

    Contexts that include a masked or unknown neighbour fall back to the
    background row. Ties of the argmax go to the alphabetically first residue.
    """
    return with_context(sites, model).select(
        *sites.columns, site_log_prob(F.col("label")).alias("lp_true"), F.coalesce("pred", "bg_pred").alias("predicted"),
        F.try_element_at("bg", F.col("label")).alias("bg_lp_true"), F.col("bg_pred").alias("bg_predicted"))


def context_model_eval(test: DataFrame, model: DataFrame, key: str = "seq_id", seq: str = "sequence",
                       p: float = 0.15, seed: int = 42) -> DataFrame:
    """K6: masked-residue accuracy (A11) and perplexity (A15) of the context
    model and of its background (no-context) form on held-out sequences, from one pass over the chosen sites."""
    x = predict_sites(masked_sites_of(test, key, seq, p, seed), model)

    def measures(predicted: str, lp: str) -> list[Column]:
        return [F.avg((F.col(predicted) == F.col("label")).cast("double")).alias("accuracy"), F.exp(F.avg(-F.col(lp))).alias("perplexity")]

    both = [("context", *measures("predicted", "lp_true")), ("background", *measures("bg_predicted", "bg_lp_true"))]
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_sites"), acc, ppl) for name, acc, ppl in both])
    return x.agg(rows.alias("r")).select(F.inline("r"))
