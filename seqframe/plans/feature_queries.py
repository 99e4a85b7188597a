"""Registered queries: descriptor features, pooling, history tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqframe.functions import sequences as sq
from seqframe.operators import features as ft
from seqframe.operators import history as hi
from seqframe.operators import metrics as mt
from seqframe.operators import pooling as pl
from seqframe.operators import split as sp
from seqframe.operators.ranking import row_number_by
from seqframe.plans import sqlparts as q
from seqframe.plans.registry import query
from seqframe.sources import tables as t

R = 6


def _values_sql(name: str, table: dict) -> str:
    rows = ", ".join(f"('{aa}', [{', '.join(repr(float(v)) for v in vals)}]::DOUBLE[])" for aa, vals in table.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(aa, vals))"


DESC_CTES = [_values_sql("d_" + n, tab) for n, tab in ft.BUNDLED.items()]

F1_SQL = q.with_ctes(q.RESIDUES, DESC_CTES, body=""",
x AS (SELECT r.seq_id, r.pos, unnest(d.vals) AS v, unnest(generate_series(1, len(d.vals))) AS j, len(d.vals) AS dd
      FROM residues r JOIN d_z3_hellberg d USING (aa))
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(count(*) AS BIGINT) AS n_features,
       CAST(sum(CAST(round(v * 100) AS BIGINT) * ((pos - 1) * dd + j)) AS BIGINT) AS by_place,
       CAST(sum(CAST(round(v * 100) AS BIGINT) * ((pos - 1) * dd + j) * ((pos - 1) * dd + j)) AS BIGINT) AS by_place_squared
FROM x GROUP BY seq_id""")

_WEIGHTS = np.arange(97 * 512) % 97 + 1.0


# a checksum over features weighs them by place modulo a prime: sums stay small enough to compare to 4 decimals
def _checksum(features: str = "features"):
    @F.arrow_udf("double")
    def weighed(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        lists = vectors.offsets.to_numpy().tolist()
        values = vectors.values.to_numpy(zero_copy_only=False)
        for i, (lo, hi) in enumerate(zip(lists, lists[1:])):
            for at in range(lo, hi, _WEIGHTS.size):  # a multiple of 97
                x = values[at:min(at + _WEIGHTS.size, hi)]
                out[i] += x @ _WEIGHTS[:len(x)]
        missing = vectors.is_null().to_numpy(zero_copy_only=False) | np.isnan(out)
        return pa.array(out, mask=missing)

    return F.round(weighed(F.col(features)), 4)



def _by_place(power: int):
    """Exact sum of the values (two decimals, as hundredths) times their place, or its square."""
    def weighed(x, i):
        h = F.floor(x * 100.0 + 0.5)
        return h * (i + 1) if power == 1 else h * (i + 1) * (i + 1)
    return F.aggregate(F.transform("features", weighed), F.lit(0).cast("bigint"), lambda a, x: a + x)


@query("descriptor_features", ("F1", "F2", "X2"), F1_SQL)
def descriptor_features(spark, sf):
    """Concatenated per-residue z-scale vectors of every whole sequence, with
    their number and two exact sums in which every place has its own weight."""
    f = ft.aa_features(t.seqs(spark, sf), "sequence", ft.Z3_HELLBERG)
    return f.select(F.col("seq_id").cast("bigint"), F.size("features").cast("bigint").alias("n_features"),
                    _by_place(1).alias("by_place"), _by_place(2).alias("by_place_squared"))


ORDERS = 6
COSINE_SQL = q.with_ctes(q.RESIDUES, DESC_CTES, body=f""",
n AS (SELECT seq_id, length(sequence) AS n FROM seqs),
z AS (SELECT r.seq_id, r.pos, n.n, unnest(d.vals) AS v, unnest(generate_series(0, len(d.vals) - 1)) AS j
      FROM residues r JOIN d_z3_hellberg d USING (aa) JOIN n USING (seq_id)),
o AS (SELECT unnest(generate_series(0, {ORDERS - 1})) AS k)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(j * {ORDERS} + k AS INTEGER) AS i,
       round(sum(v * cos(pi() * k * (pos - 0.5) / n)) / max(n), 6) + 0.0 AS value
FROM z CROSS JOIN o GROUP BY seq_id, j, k""")


@query("cosine_features", ("F1", "F2"), COSINE_SQL)
def cosine_features(spark, sf):
    """The course of three z-scales along every whole sequence: 18 values a sequence."""
    f = ft.cosine_features(t.seqs(spark, sf), "sequence", ft.Z3_HELLBERG, ORDERS)
    return f.select(F.col("seq_id").cast("bigint"), F.posexplode("features").alias("i", "value")).select(
        "seq_id", "i", (F.round("value", R) + 0.0).alias("value"))


def _pair_sql():
    names = sorted(ft.BUNDLED)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    parts = []
    for a, b in pairs:
        parts.append(f"""SELECT r.seq_id, '{a}+{b}' AS pair, r.pos, da.vals AS va, db.vals AS vb
  FROM residues r JOIN d_{a} da USING (aa) JOIN d_{b} db USING (aa)""")
    return " UNION ALL ".join(parts)


PAIRS_SQL = q.with_ctes(q.RESIDUES, DESC_CTES, body=f""",
p AS ({_pair_sql()}),
a AS (SELECT seq_id, pair, pos, unnest(va) AS v, unnest(generate_series(1, len(va))) AS j, len(va) AS da FROM p),
b AS (SELECT seq_id, pair, pos, unnest(vb) AS v, unnest(generate_series(1, len(vb))) AS j, len(vb) AS db FROM p),
ia AS (SELECT seq_id, pair, (pos - 1) * da + j AS idx, v FROM a),
nb AS (SELECT seq_id, pair, max(pos) * max(da) AS off FROM a GROUP BY seq_id, pair),
ib AS (SELECT b.seq_id, b.pair, nb.off + (b.pos - 1) * b.db + b.j AS idx, b.v FROM b JOIN nb USING (seq_id, pair)),
al AS (SELECT * FROM ia UNION ALL SELECT * FROM ib)
SELECT CAST(seq_id AS BIGINT) AS seq_id, pair, CAST(count(*) AS BIGINT) AS n_features,
       round(sum(v * ((idx - 1) % 97 + 1)), 4) AS checksum
FROM al GROUP BY seq_id, pair""")


#: Eight descriptors made of the bundled ones: each whole, each z-scale alone, and two sums.
EIGHT = {**ft.BUNDLED, **{f"z{i + 1}": {a: [v[i]] for a, v in ft.Z3_HELLBERG.items()} for i in range(3)},
         "z_sum": {a: [round(sum(v), 2)] for a, v in ft.Z3_HELLBERG.items()},
         "hydro_sum": {a: [round(v[0] + ft.HOPP_WOODS[a][0], 2)] for a, v in ft.KYTE_DOOLITTLE.items()}}
EIGHT_SQL = q.with_ctes(q.REFS, [
    "d(name, aa, vals) AS (VALUES " + ", ".join(f"('{n}', '{a}', [{', '.join(repr(float(x)) for x in v)}]::DOUBLE[])"
                                                 for n, tab in EIGHT.items() for a, v in tab.items()) + ")"], body=""",
l AS (SELECT seq_id, CAST(i AS INTEGER) AS pos, substr(sequence, i, 1) AS aa FROM (SELECT *, unnest(generate_series(1, length(sequence))) AS i FROM refs)),
c AS (SELECT seq_id, name, flatten(list(vals ORDER BY pos)) AS v FROM l JOIN d USING (aa) GROUP BY seq_id, name),
p AS (SELECT a.seq_id, a.name || '+' || b.name AS pair, list_concat(a.v, b.v) AS v FROM c a JOIN c b ON a.seq_id = b.seq_id AND a.name < b.name),
u AS (SELECT seq_id, pair, unnest(v) AS v, unnest(generate_series(1, len(v))) AS i FROM p)
SELECT CAST(seq_id AS BIGINT) AS seq_id, pair, CAST(count(*) AS BIGINT) AS n_features,
  CAST(sum(CAST(round(v * 100) AS BIGINT) * i) AS BIGINT) AS by_place, CAST(sum(CAST(round(v * 100) AS BIGINT) * i * i) AS BIGINT) AS by_place_squared
FROM u GROUP BY seq_id, pair""")


@query("descriptor_pair_tables", ("J3", "U2", "F2"), EIGHT_SQL)
def descriptor_pair_tables(spark, sf):
    """All 28 pairs of eight descriptors for the reference proteins, written by pair in one pass and read back."""
    import uuid

    from seqframe.session import scratch_path

    desc = ft.descriptor_table(spark, list(EIGHT), EIGHT)
    path = scratch_path(spark, f"descriptor-pairs-{uuid.uuid4().hex}")
    ft.write_descriptor_pairs(ft.descriptor_pairs(t.references(spark, sf), "seq_id", "sequence", desc), path)
    back = spark.read.schema("seq_id bigint, features array<double>, pair string").parquet(path)
    return back.select("seq_id", "pair", F.size("features").cast("bigint").alias("n_features"),
                       _by_place(1).alias("by_place"), _by_place(2).alias("by_place_squared"))


POOLS_SQL = q.with_ctes(q.RESIDUES, DESC_CTES, body=""",
x AS (SELECT r.seq_id, r.pos, unnest(d.vals) AS v, unnest(generate_series(0, len(d.vals) - 1)) AS j FROM residues r JOIN d_z3_hellberg d USING (aa)),
w AS (SELECT seq_id, j, v FROM x UNION ALL
      SELECT seq_id, j + 3, avg(v) OVER (PARTITION BY seq_id, j ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) FROM x),
g AS (SELECT seq_id, j, avg(v) AS mean, max(v) AS max, sum(v) AS sum FROM w GROUP BY seq_id, j)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(j AS INTEGER) AS i, round(mean, 6) + 0.0 AS mean, round(max, 6) + 0.0 AS max, round(sum, 4) + 0.0 AS sum FROM g""")


@query("embedding_pools", ("F3", "F4", "D2", "A1", "A2", "A3"), POOLS_SQL)
def embedding_pools(spark, sf):
    """Every whole sequence through the batched window encoder once, pooled by mean, max and sum."""
    x = pl.embed_pools(t.seqs(spark, sf), "sequence", pl.descriptor_window_encoder(ft.Z3_HELLBERG, window=2))
    x = x.select(F.col("seq_id").cast("bigint"), F.posexplode(F.arrays_zip("pools.mean", "pools.max", "pools.sum")).alias("i", "v"))
    return x.select("seq_id", "i", *[(F.round(f"v.{p}", d) + 0.0).alias(p) for p, d in (("mean", R), ("max", R), ("sum", 4))])


@query("descriptor_pairs", ("J2", "J3", "F1"), PAIRS_SQL)
def descriptor_pairs(spark, sf):
    """Features of every 2-combination of descriptors (concatenated), with a
    position-weighted checksum per (sequence, pair)."""
    wide = ft.aa_features_multi(t.seqs(spark, sf), "sequence", ft.BUNDLED)
    long = ft.all_descriptor_pairs(wide, "seq_id", list(ft.BUNDLED))
    return long.select(F.col("seq_id").cast("bigint"), "pair", F.size("features").cast("bigint").alias("n_features"),
                       _checksum().alias("checksum"))


@query("descriptor_pair_join", ("J2", "J1"), q.with_ctes(q.RESIDUES, DESC_CTES, body=""",
a AS (SELECT r.seq_id, sum(d.vals[1] * ((r.pos - 1) % 97 + 1)) AS s1, count(*) AS n1 FROM residues r JOIN d_kyte_doolittle d USING (aa) GROUP BY r.seq_id),
b AS (SELECT r.seq_id, sum(d.vals[1] * ((r.pos + length(s.sequence) - 1) % 97 + 1)) AS s2, count(*) AS n2
  FROM residues r JOIN seqs s ON s.seq_id = r.seq_id JOIN d_hopp_woods d USING (aa) GROUP BY r.seq_id)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(n1 + n2 AS BIGINT) AS n_features, round(s1 + s2, 4) AS checksum
FROM a JOIN b USING (seq_id)"""))
def descriptor_pair_join(spark, sf):
    """Two separately computed feature tables joined by key."""
    f1 = ft.aa_features(t.seqs(spark, sf), "sequence", ft.KYTE_DOOLITTLE)
    f2 = ft.aa_features(t.seqs(spark, sf), "sequence", ft.HOPP_WOODS)
    j = ft.pair_features(f1, f2.drop("sequence"), "seq_id")
    return j.select(F.col("seq_id").cast("bigint"), F.size("features").cast("bigint").alias("n_features"),
                    _checksum().alias("checksum"))


@query("residue_hydropathy", ("J4", "D4"), q.with_ctes(q.RESIDUES, DESC_CTES, body="""
SELECT CAST(r.seq_id AS BIGINT) AS seq_id, round(avg(d.vals[1]), 6) AS mean_hydropathy
FROM residues r LEFT JOIN d_kyte_doolittle d USING (aa) GROUP BY r.seq_id"""))
def residue_hydropathy(spark, sf):
    """Residue -> descriptor lookup as a (broadcast) join, averaged per sequence."""
    desc = ft.descriptor_table(spark, ["kyte_doolittle"])
    j = ft.residue_lookup(t.residues(spark, sf), desc)
    return j.groupBy("seq_id").agg(F.round(F.avg(F.col("values")[0]), R).alias("mean_hydropathy")).select(
        F.col("seq_id").cast("bigint"), "mean_hydropathy")


PART_SQL = q.with_ctes(DESC_CTES, body=""",
l AS (SELECT p_partkey, p_brand, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part),
c AS (SELECT p_partkey, p_brand, s,
        length(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) AS n_bad FROM l)
SELECT p_brand, bool_or(n_bad > 0 OR length(s) = 0) AS has_missing, CAST(count(*) AS BIGINT) AS n_parts
FROM c GROUP BY p_brand""")


@query("feature_missing", ("P14", "F1"), PART_SQL)
def feature_missing(spark, sf):
    """Does any part name contain residues without a descriptor? (per brand)"""
    p = t.table(spark, sf, "part").select("p_partkey", "p_brand", sq.ascii_letters_upper("p_name").alias("s"))
    f = ft.aa_features(p, "s", ft.Z3_HELLBERG)
    f = f.withColumn("features", F.when(F.length("s") == 0, F.lit(None)).otherwise(F.col("features")))
    m = mt.has_missing(f, "features", ["p_brand"])
    n = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))
    return m.join(n, "p_brand")


POOL_SQL = """
WITH l AS (SELECT label AS seq_id, unnest(generate_series(0, len(embedding) - 1)) AS dim,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(dim AS BIGINT) AS dim,
       round(avg(x), 6) AS mean, round(sum(x), 5) AS sum, round(max(x), 6) AS max
FROM l GROUP BY seq_id, dim"""


@query("pooled_embeddings", ("A1", "A2", "A3"), POOL_SQL)
def pooled_embeddings(spark, sf):
    """Mean / sum / max pooling of per-residue vectors per sequence."""
    p = pl.pool_all(t.vectors(spark, sf), "seq_id", "embedding")
    z = F.arrays_zip("mean", "sum", "max")
    x = p.select("seq_id", F.posexplode(z).alias("dim", "v"))
    return x.select(F.col("seq_id").cast("bigint"), F.col("dim").cast("bigint"),
                    F.round("v.mean", R).alias("mean"), F.round("v.sum", 5).alias("sum"),
                    F.round("v.max", R).alias("max"))


GLOBAL_SQL = """
WITH l AS (SELECT label AS seq_id, unnest(generate_series(0, len(embedding) - 1)) AS dim,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
a AS (SELECT seq_id, dim, avg(x) AS mean, max(x) AS mx FROM l GROUP BY seq_id, dim)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(dim AS BIGINT) AS idx, round(mean, 6) AS value FROM a
UNION ALL
SELECT CAST(seq_id AS BIGINT), CAST(dim + 64 AS BIGINT), round(mx, 6) FROM a"""


@query("global_pool", ("A4",), GLOBAL_SQL)
def global_pool(spark, sf):
    p = pl.pool(t.vectors(spark, sf), "seq_id", "embedding", "global")
    return p.select(F.col("seq_id").cast("bigint"), F.posexplode("pooled").alias("idx", "value")).select(
        "seq_id", F.col("idx").cast("bigint"), F.round("value", R).alias("value"))


HIST_CTE = ["""hist AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
  value AS val_loss FROM events)"""]

EARLY_SQL = q.with_ctes(HIST_CTE, body=""",
a AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hist),
b AS (SELECT *, (prev IS NULL OR val_loss < prev) AS improved FROM a),
c AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM b),
st AS (SELECT run, min(epoch) AS stop_epoch FROM c WHERE epoch - last_imp >= 5 GROUP BY run),
be AS (SELECT c.run, st.stop_epoch, CASE WHEN st.stop_epoch IS NULL THEN (SELECT max(epoch) FROM c c2 WHERE c2.run = c.run AND c2.improved)
            ELSE max(CASE WHEN c.epoch = st.stop_epoch THEN c.last_imp END) END AS best_epoch
       FROM c LEFT JOIN st USING (run) GROUP BY c.run, st.stop_epoch)
SELECT CAST(be.run AS BIGINT) AS run, CAST(be.stop_epoch AS BIGINT) AS stop_epoch,
       CAST(be.best_epoch AS BIGINT) AS best_epoch, h.val_loss AS best_loss
FROM be JOIN hist h ON h.run = be.run AND h.epoch = be.best_epoch""")


@query("early_stopping", ("W6",), EARLY_SQL)
def early_stopping(spark, sf):
    """Stop and best epoch per run with patience 5 (strict improvement)."""
    h = t.history(spark, sf)
    e = hi.early_stopping(h, patience=5)
    return e.select(F.col("run").cast("bigint"), F.col("stop_epoch").cast("bigint"),
                    F.col("best_epoch").cast("bigint"), "best_loss")


REPORT_SQL = """
WITH rows AS (SELECT user_id AS run,
     row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'view' THEN 'train' ELSE 'eval' END ORDER BY event_id) AS epoch,
     CASE WHEN event_type = 'view' THEN 'train' ELSE 'eval' END AS kind, value FROM events),
m AS (SELECT run, epoch, max(CASE WHEN kind = 'train' THEN value END) AS loss,
             max(CASE WHEN kind = 'eval' THEN value END) AS eval_loss FROM rows GROUP BY run, epoch),
l AS (SELECT run, max(epoch) AS last FROM m GROUP BY run)
SELECT CAST(m.run AS BIGINT) AS run, CAST(m.epoch AS BIGINT) AS epoch, m.loss, m.eval_loss
FROM m JOIN l USING (run) WHERE m.epoch < l.last AND (m.epoch = 1 OR m.epoch % 10 = 0)"""


@query("history_report", ("J9", "W7"), REPORT_SQL)
def history_report(spark, sf):
    """Train rows ('view' events) and eval rows (others) merged per epoch,
    final row dropped, first and every 10th epoch kept."""
    ev = t.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    ev = ev.withColumn("kind", F.when(F.col("event_type") == "view", F.lit("train")).otherwise(F.lit("eval")))
    rows = row_number_by(ev, ["event_id"], by=["user_id", "kind"], out="epoch")
    rows = rows.select(F.col("user_id").alias("run"), "epoch", "kind", "value")
    rep = hi.history_report(hi.merge_history(rows))
    return rep.select(F.col("run").cast("bigint"), F.col("epoch").cast("bigint"), "loss", "eval_loss")


def _lr_sql(batch: int = 8, epochs: int = 20, lr: float = 1e-5, warmup: int = 500) -> str:
    return q.with_ctes(q.SEQS, body=f""",
tvt_r AS (SELECT seq_id, row_number() OVER (ORDER BY {q_hash()}, seq_id) AS rn, count(*) OVER () AS n FROM seqs),
n AS (SELECT CAST(ceil((max(n) - ceil(0.2 * max(n)) - ceil(0.2 * (max(n) - ceil(0.2 * max(n))))) / {batch}.0) * {epochs} AS BIGINT) AS total FROM tvt_r),
s AS (SELECT unnest(generate_series(0, total - 1)) AS step, total FROM n)
SELECT CAST(step AS BIGINT) AS step,
  round(CASE WHEN step < {warmup} THEN {lr} * step / {float(max(1, warmup))}
        ELSE {lr} * greatest(0.0, 0.5 * (1.0 + cos({math.pi!r} * (step - {warmup}) / greatest(1, total - {warmup})))) END * 1e6, 9) AS lr_micro
FROM s""")


def q_hash():
    from seqframe.functions.hashing import stable_hash_sql
    return stable_hash_sql(42, "seq_id")


@query("lr_schedule", ("W8",), _lr_sql())
def lr_schedule(spark, sf, batch: int = 8, epochs: int = 20, lr: float = 1e-5, warmup: int = 500):
    """Warm-up + cosine learning rate for every optimiser step of a run over
    the training split (steps = ceil(train rows / batch) x epochs)."""
    s = sp.train_valid_test(t.seqs(spark, sf), "seq_id")
    n_train = s.where(F.col("split") == "train").count()  # one scalar
    steps = math.ceil(n_train / batch) * epochs
    sched = hi.lr_schedule(spark, steps, lr, warmup)
    return sched.select(F.col("step").cast("bigint"), F.round(F.col("lr") * 1e6, 9).alias("lr_micro"))
