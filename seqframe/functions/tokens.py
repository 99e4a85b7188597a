"""K1/K2: residue tokenization and padding as array expressions.

Token ids are looked up through a literal map inside ``transform`` so the
whole tokenizer runs in generated JVM code, one pass per row, no UDF.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
# Residue-level vocabulary of the small public protein language models
# (ESM-2 family), index = token id.
VOCAB = [
    "<cls>", "<pad>", "<eos>", "<unk>",
    "L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N",
    "F", "Y", "M", "H", "W", "C", "X", "B", "U", "Z", "O", ".", "-",
    "<null_1>", "<mask>",
]
BOS_ID, PAD_ID, EOS_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 32
MAX_LENGTH = 1024
# --------------------------------------------------------------------------

TOKEN_IDS = {t: i for i, t in enumerate(VOCAB)}


def vocab_map(vocab: dict | None = None) -> Column:
    v = vocab or TOKEN_IDS
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(i))) for k, i in v.items()))


def tokenize(seq, max_length: int = MAX_LENGTH, vocab: dict | None = None,
             bos: int = BOS_ID, eos: int = EOS_ID, unk: int = UNK_ID) -> Column:
    """K1: begin token, residue ids (truncated to max_length - 2), end token."""
    s = F.col(seq) if isinstance(seq, str) else seq
    m = vocab_map(vocab)
    residues = F.slice(F.split(s, ""), 1, max_length - 2)
    ids = F.transform(residues, lambda x: F.coalesce(F.element_at(m, x), F.lit(unk)))
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def pad(ids, length, pad_id: int = PAD_ID) -> Column:
    """K2: right-pad an id array to ``length`` (int or column)."""
    a = F.col(ids) if isinstance(ids, str) else ids
    n = F.lit(length) if isinstance(length, int) else length
    fill = F.greatest(n - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(pad_id), fill))


def attention_mask(ids, pad_id: int = PAD_ID) -> Column:
    """K2: 1 for real tokens, 0 for padding."""
    a = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(a, lambda x: F.when(x == F.lit(pad_id), F.lit(0)).otherwise(F.lit(1)))
