"""Residue descriptor features.

A descriptor is a small lookup table ``aa -> values``. ``aa_features``
looks the letters of a batch of sequences up in an array, so the concatenated
per-residue feature vectors are built without an explode, a join or a
shuffle. ``residue_lookup`` is the equivalent join form
for long residue tables.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from seqframe.operators.relational import attach_row
from seqframe.session import literal_table

# Fixed values -------------------------------------------------------------
# Descriptor names used for the reference's feature sets. Their numeric
# tables are not bundled; supply them as a (descriptor, aa, values) table.
REFERENCE_DESCRIPTORS = (
    "blosum_indices", "fasgai_vectors", "ms_whim_scores", "protfp_descriptors",
    "st_scales", "t_scales", "vhse_scales", "z_scales",
)
# Spelling variants accepted for descriptor names.
ALIASES = {"vhse_scale": "vhse_scales"}

# Bundled example descriptors, transcribed from the published papers
# (not verified against a machine-readable source):
# three z-scales (Hellberg et al., J. Med. Chem. 1987),
Z3_HELLBERG = {
    "A": [0.07, -1.73, 0.09], "R": [2.88, 2.52, -3.44], "N": [3.22, 1.45, 0.84],
    "D": [3.64, 1.13, 2.36], "C": [0.71, -0.97, 4.13], "Q": [2.18, 0.53, -1.14],
    "E": [3.08, 0.39, -0.07], "G": [2.23, -5.36, 0.30], "H": [2.41, 1.74, 1.11],
    "I": [-4.44, -1.68, -1.03], "L": [-4.19, -1.03, -0.98], "K": [2.84, 1.41, -3.14],
    "M": [-2.49, -0.27, -0.41], "F": [-4.92, 1.30, 0.45], "P": [-1.22, 0.88, 2.23],
    "S": [1.96, -1.63, 0.57], "T": [0.92, -2.09, -1.40], "W": [-4.75, 3.65, 0.85],
    "Y": [-1.39, 2.32, 0.01], "V": [-2.69, -2.53, -1.29],
}
# hydropathy (Kyte & Doolittle, J. Mol. Biol. 1982),
KYTE_DOOLITTLE = {
    "A": [1.8], "R": [-4.5], "N": [-3.5], "D": [-3.5], "C": [2.5], "Q": [-3.5], "E": [-3.5],
    "G": [-0.4], "H": [-3.2], "I": [4.5], "L": [3.8], "K": [-3.9], "M": [1.9], "F": [2.8],
    "P": [-1.6], "S": [-0.8], "T": [-0.7], "W": [-0.9], "Y": [-1.3], "V": [4.2],
}
# hydrophilicity (Hopp & Woods, PNAS 1981).
HOPP_WOODS = {
    "A": [-0.5], "R": [3.0], "N": [0.2], "D": [3.0], "C": [-1.0], "Q": [0.2], "E": [3.0],
    "G": [0.0], "H": [-0.5], "I": [-1.8], "L": [-1.8], "K": [3.0], "M": [-1.3], "F": [-2.5],
    "P": [0.0], "S": [0.3], "T": [-0.4], "W": [-3.4], "Y": [-2.3], "V": [-1.5],
}
BUNDLED = {"z3_hellberg": Z3_HELLBERG, "kyte_doolittle": KYTE_DOOLITTLE, "hopp_woods": HOPP_WOODS}
# --------------------------------------------------------------------------


def canonical(name: str) -> str:
    return ALIASES.get(name, name)


def descriptor_table(spark: SparkSession, names=None, tables: dict | None = None) -> DataFrame:
    """(descriptor, aa, values ARRAY<DOUBLE>) for the given names."""
    src = dict(BUNDLED)
    src.update(tables or {})
    names = [canonical(n) for n in (names or list(src))]
    rows = []
    for n in names:
        if n not in src:
            raise ValueError(f"descriptor {n!r} has no bundled values; pass it in `tables`")
        rows += [(n, aa, [float(v) for v in vals]) for aa, vals in src[n].items()]
    return literal_table(spark, rows, ["descriptor", "aa", "values"])


def descriptor_map(table: dict[str, list[float]]) -> Column:
    """Literal map<aa, array<double>> (20 entries)."""
    return F.create_map(*chain.from_iterable(
        (F.lit(aa), F.array(*[F.lit(float(v)) for v in vals])) for aa, vals in table.items()))


def aa_features(df: DataFrame, seqcol: str, table: dict[str, list[float]], out: str = "features") -> DataFrame:
    """concatenated descriptor vectors of all residues, in order.

    Residues without a descriptor make the whole vector null (P14 finds them).
    """
    return _encoded(df, seqcol, {out: table})


def _encoded(df: DataFrame, seqcol: str, tables: dict[str, dict[str, list[float]]]) -> DataFrame:
    """``df`` with a vector column for each table, all from one look at the letters.

    Values are looked up by letter code in arrays, some 2^17 letters at a time; narrow, no shuffle. An empty or null
    sequence and one with a letter that a table lacks have a null vector.
    """
    lookups = []
    for table in tables.values():
        if any(len(aa) != 1 or ord(aa) > 127 for aa in table):
            raise ValueError("descriptors are given for single ASCII letters")
        known = np.zeros(256, bool)
        known[[ord(aa) for aa in table]] = True
        values = np.zeros((256, len(next(iter(table.values())))))
        for aa, vals in table.items():
            values[ord(aa)] = vals
        lookups.append((known, values))
    kept = [c for c in df.columns if c not in tables]
    schema = StructType([StructField(c, df.schema[c].dataType) for c in kept] + [StructField(c, ArrayType(DoubleType())) for c in tables])

    def encode(batches):
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(len(kept))), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(size // _CHUNK)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    texts = [x or b"" for x in part.column(len(kept)).cast(pa.binary()).to_pylist()]
                    codes, n = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts])
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *(vectors(codes, n, *x) for x in lookups)], names=schema.names)

    def vectors(codes, n, known, values):
        ends = np.cumsum(n)
        missing = np.r_[0, np.cumsum(~known[codes])]
        whole = (n > 0) & (missing[ends] == missing[ends - n])
        if not whole.all():
            codes = codes[np.repeat(whole, n)]
        offsets = np.r_[0, np.cumsum(np.where(whole, n, 0))] * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[codes].ravel()), mask=pa.array(~whole))

    return df.select(*kept, F.col(seqcol).cast("string").alias("_letters")).mapInArrow(encode, schema)


def composition(df: DataFrame, seqcol: str, out: str = "features", alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """Share of each letter in the whole sequence: as wide as the alphabet for sequences of any length (empty: zeros)."""
    n = F.length(seqcol)
    shares = [(n - F.length(F.replace(F.col(seqcol), F.lit(a), F.lit("")))) / F.greatest(n, F.lit(1)) for a in alphabet]
    return df.withColumn(out, F.array(*shares))


#: Letters whose cosines are taken at a time (some 10 MB of numbers).
_CHUNK = 1 << 17


def courses(seqs, lookup: np.ndarray, orders: int) -> np.ndarray:
    """``cosine_features`` of a batch of sequences, a row each; ``lookup`` has 256 rows of values by letter code."""
    width = lookup.shape[1]

    def sums(letters, place, starts):
        z, got = lookup[letters], np.empty((len(starts), width, orders))
        for k in range(orders):
            got[:, :, k] = np.add.reduceat(z * np.cos(k * place)[:, None], starts)
        return got

    res = np.zeros((len(seqs), width * orders))
    held, at, size = [], [], 0

    def drain():
        n = np.array([len(x) for x in held])
        starts = np.cumsum(n) - n
        place = (np.arange(size) - np.repeat(starts, n) + 0.5) * np.repeat(np.pi / n, n)
        res[at] = (sums(np.frombuffer(b"".join(held), np.uint8), place, starts) / n[:, None, None]).reshape(len(held), -1)

    for i, s in enumerate(seqs):
        text = (s or "").encode("latin-1", "replace")
        if len(text) > _CHUNK:
            parts = ((text[lo:lo + _CHUNK], lo) for lo in range(0, len(text), _CHUNK))
            total = sum(sums(np.frombuffer(x, np.uint8), (np.arange(lo, lo + len(x)) + 0.5) * (np.pi / len(text)), [0]) for x, lo in parts)
            res[i] = (total / len(text)).ravel()
        elif text:
            held.append(text)
            at.append(i)
            size += len(text)
            if size > _CHUNK:
                drain()
                held, at, size = [], [], 0
    if held:
        drain()
    return res


def cosine_features(df: DataFrame, seqcol: str, table: dict[str, list[float]], orders: int = 6, out: str = "features") -> DataFrame:
    """Each descriptor's course along the whole sequence, at one width for any length.

    Value d * orders + k is the mean over the n residues of descriptor d times
    cos(pi * k * (place - 1/2) / n), places from 1: order 0 is the mean, the others
    tell where in the sequence high and low values stand, so that the
    same change at two places gives two vectors. A letter without a descriptor
    counts as zeros; an empty sequence gives zeros and a null one null.
    Sequences of an Arrow batch are put together to arrays of about 2^17 letters; a
    longer sequence is summed in slices of as many, so memory does not grow with its length.
    """
    width = len(next(iter(table.values())))
    lookup = np.zeros((256, width))
    for aa, vals in table.items():
        lookup[ord(aa)] = vals

    @F.pandas_udf("array<double>")
    def course(seqs: pd.Series) -> pd.Series:
        res = courses(seqs, lookup, orders)
        return pd.Series([None if s is None else v for s, v in zip(seqs, res)], dtype=object)

    return df.withColumn(out, course(F.col(seqcol)))


def aa_features_multi(df: DataFrame, seqcol: str, tables: dict[str, dict]) -> DataFrame:
    """F1 for several descriptors in one pass: one ``features_<name>`` column each."""
    return _encoded(df, seqcol, {f"features_{name}": tab for name, tab in tables.items()})


def residue_lookup(residues: DataFrame, desc: DataFrame, how: str = "left") -> DataFrame:
    """Residues (.., aa) joined with a descriptor table (20 rows per
    descriptor: bounded, broadcast)."""
    return residues.join(F.broadcast(desc), "aa", how)


def combinations(names: DataFrame, col: str = "descriptor") -> DataFrame:
    """Unordered pairs (a < b) of a (small) name table, as a self-join."""
    a = names.select(F.col(col).alias("a"))
    b = names.select(F.col(col).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def pair_features(f1: DataFrame, f2: DataFrame, key: str, features: str = "features",
                  label_cols=("label", "split"), out: str = "features") -> DataFrame:
    """Keyed join of two feature tables; label/split dropped from the
    left, features concatenated (left first)."""
    left = f1.drop(*[c for c in label_cols if c in f1.columns]).withColumnRenamed(features, "_f1")
    right = f2.withColumnRenamed(features, "_f2")
    right = right.drop(*[c for c in right.columns if c != key and c in left.columns])
    j = left.join(right, key)
    return j.withColumn(out, F.concat("_f1", "_f2")).drop("_f1", "_f2")


#: Entries of a descriptor table that is attached to every row as one map at most; it is counted first.
MAX_DESCRIPTOR_ROWS = 5_000


def descriptor_pairs(df: DataFrame, key: str, seqcol: str, table: DataFrame, out: str = "features") -> DataFrame:
    """(key, pair, features) for every unordered pair of the descriptors in ``table`` (descriptor, aa, values).

    Names are paired by a self-join (U2); the pairs and the values are attached to
    each row as one array and one map, a sequence is encoded once by each descriptor,
    and the encodings are put together by pair. Nothing is shuffled by key. A letter without
    a value makes a vector null.
    """
    n = table.limit(MAX_DESCRIPTOR_ROWS + 1).count()
    if n > MAX_DESCRIPTOR_ROWS:
        raise ValueError(f"a descriptor table has at most {MAX_DESCRIPTOR_ROWS} entries")
    by_letter = table.groupBy("descriptor").agg(F.map_from_entries(F.collect_list(F.struct("aa", "values"))).alias("m"))
    maps = by_letter.agg(F.map_from_entries(F.collect_list(F.struct("descriptor", "m"))).alias("_maps"))
    pairs = combinations(table.select("descriptor").distinct())
    pairs = pairs.agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_pairs"))
    x = attach_row(attach_row(df.select(key, F.split(F.col(seqcol), "").alias("_letters")), maps), pairs)
    x = x.withColumn("_code", F.transform_values("_maps", lambda name, m: F.flatten(F.transform("_letters", lambda a: F.try_element_at(m, a)))))
    x = x.select(key, "_code", F.explode("_pairs").alias("p"))
    return x.select(key, F.concat_ws("+", "p.a", "p.b").alias("pair"), F.concat(F.element_at("_code", F.col("p.a")), F.element_at("_code", F.col("p.b"))).alias(out))


def write_descriptor_pairs(pairs: DataFrame, path: str) -> None:
    """J3 sink: one folder a pair, written in one pass over the encoded rows."""
    pairs.write.mode("overwrite").partitionBy("pair").parquet(path)


def all_descriptor_pairs(wide: DataFrame, key: str, names: list[str], out: str = "features") -> DataFrame:
    """For every 2-combination of descriptors, the concatenated features.

    ``wide`` holds one ``features_<name>`` column per descriptor (from
    ``aa_features_multi``); the result is long (key, pair, features) and is
    produced per row with one explode - no join, no shuffle.
    """
    names = sorted(canonical(n) for n in names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    structs = [F.struct(F.lit(f"{a}+{b}").alias("pair"),
                        F.concat(F.col(f"features_{a}"), F.col(f"features_{b}")).alias(out))
               for a, b in pairs]
    return wide.select(key, F.explode(F.array(*structs)).alias("_p")).select(key, "_p.pair", f"_p.{out}")
