"""Column expressions on residue strings (all JVM-side, codegen-friendly)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
# The 20 standard residues, in one-letter-code alphabetical order.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
# Rare residues replaced by X for spaced-input encoders.
RARE_RESIDUES = "UZOB"
# Prefix telling a fold-aware encoder that the input is an amino-acid string.
FOLD_PREFIX = "<AA2fold>"
# Characters deleted from aligned (A3M) records: insertions and gap markers.
INSERTION_CHARS = string.ascii_lowercase + ".*"
# Input families of encoders: how a sequence is prepared before tokenizing.
FAMILIES = ("plain", "spaced", "fold", "pair")
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_residues(text, alphabet: str = ALPHABET) -> Column:
    """Keep ASCII letters whose upper case is in ``alphabet``, upper-cased.

    One regex pass over the whole text (no per-character Python); runs of
    dropped characters are removed as one match.
    """
    allowed = alphabet + alphabet.lower()
    return F.upper(F.regexp_replace(_c(text), f"[^{allowed}]+", ""))


def ascii_letters_upper(text) -> Column:
    """Strip everything but ASCII letters, then upper-case (X4 input form)."""
    return F.upper(F.regexp_replace(_c(text), "[^A-Za-z]+", ""))


def to_residues(seq) -> Column:
    """String -> array of one-letter residues."""
    return F.split(_c(seq), "")


def space_residues(seq) -> Column:
    """X3: "MKT" -> "M K T"."""
    return F.array_join(F.split(_c(seq), ""), " ")


def mask_rare(seq) -> Column:
    """Rare residues U, Z, O, B -> X."""
    return F.regexp_replace(_c(seq), f"[{RARE_RESIDUES}]", "X")


def add_prefix(seq, prefix: str = FOLD_PREFIX) -> Column:
    """X5: "<AA2fold> " + sequence."""
    return F.concat(F.lit(prefix + " "), _c(seq))


def prepare_sequence(seq, family: str, mask: bool = True) -> Column:
    """Prepare a sequence for an encoder input family.

    plain  -> unchanged; spaced -> rare residues masked (``mask``) and spaced;
    fold   -> spaced form with the fold prefix; pair -> struct(seq, seq) (X7).
    """
    s = _c(seq)
    if family == "plain":
        return s
    if family == "spaced":
        return space_residues(mask_rare(s) if mask else s)
    if family == "fold":
        return add_prefix(space_residues(mask_rare(s) if mask else s))
    if family == "pair":
        return pair_tuple(s)
    raise ValueError(f"unknown input family {family!r}; expected one of {FAMILIES}")


def pair_tuple(seq) -> Column:
    """(seq, seq) pair for pair-input encoders."""
    s = _c(seq)
    return F.struct(s.alias("first"), s.alias("second"))


def residue_at(seq, pos) -> Column:
    """X11: residue at 1-based position."""
    return F.substring(_c(seq), _c(pos), F.lit(1)) if not isinstance(pos, int) else F.substring(_c(seq), pos, 1)


def apply_mutation(seq, pos, mt) -> Column:
    """Substitute one residue at 1-based ``pos``."""
    return F.overlay(_c(seq), _c(mt), _c(pos) if not isinstance(pos, int) else F.lit(pos), F.lit(1))


def format_mutation(wt, pos, mt) -> Column:
    """Wt + position + mt, e.g. M1A."""
    return F.concat(_c(wt), _c(pos).cast("string"), _c(mt))


def parse_mutation(code, offset: int = 1) -> Column:
    """struct(wt, pos, mt) from a code like H24C; pos = number - offset + 1.

    ``pos`` is 1-based into the given wild type: with ``offset=24`` the code
    H24C addresses the first residue. ``idx`` is the 0-based index.
    """
    c = _c(code)
    num =F.substring(c, F.lit(2), F.length(c) - F.lit(2)).try_cast("int")
    idx = num - F.lit(offset)
    return F.struct(
        F.substring(c, 1, 1).alias("wt"),
        (idx + F.lit(1)).alias("pos"),
        idx.alias("idx"),
        F.substring(c, -1, 1).alias("mt"),
    )


def remove_insertions(seq) -> Column:
    """Delete lower-case letters, '.' and '*' (A3M insertions)."""
    return F.translate(_c(seq), INSERTION_CHARS, "")


def base_name(path) -> Column:
    """Last path component of a model name, e.g. org/model -> model."""
    return F.element_at(F.split(_c(path), "/"), -1)


def unwrap_label(c) -> Column:
    """First element when the label is an array, else the value itself."""
    return F.try_element_at(_c(c), F.lit(1))


def squeeze(c) -> Column:
    """Length-1 arrays -> scalar; other arrays kept as null scalar."""
    a = _c(c)
    return F.when(F.size(a) == 1, F.try_element_at(a, F.lit(1)))
