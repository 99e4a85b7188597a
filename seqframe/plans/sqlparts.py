"""Reusable ANSI-SQL (DuckDB dialect) building blocks for the oracle queries.

Each constant is a list of CTE definitions that mirror a derived view in
``seqframe.sources.tables``; ``with_ctes`` stitches them into one WITH.
"""

from __future__ import annotations

from seqframe.functions.hashing import stable_hash_sql
from seqframe.functions.sequences import ALPHABET

ALLOWED = ALPHABET + ALPHABET.lower()

SEQS = [
    f"""seqs_raw AS (
  SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^{ALLOWED}]', '', 'g')) AS sequence FROM documents)""",
    "seqs AS (SELECT seq_id, sequence FROM seqs_raw WHERE length(sequence) > 0)",
]

ALPHA = [f"alpha AS (SELECT unnest(string_split('{ALPHABET}', '')) AS aa)"]

RESIDUES = SEQS + [
    "split_seqs AS (SELECT seq_id, string_split(sequence, '') AS letters FROM seqs)",
    """residues AS MATERIALIZED (SELECT seq_id, CAST(generate_subscripts(letters, 1) AS INTEGER) AS pos, unnest(letters) AS aa
  FROM split_seqs)""",
]

REFS = [
    f"""refs_raw AS (
  SELECT item_id AS seq_id, upper(regexp_replace(text, '[^{ALLOWED}]', '', 'g')) AS sequence FROM benchmark)""",
    "refs AS (SELECT seq_id, sequence FROM refs_raw WHERE length(sequence) > 0)",
]

WT = REFS + [
    """wt AS (SELECT sequence AS wt_sequence, seq_id AS wt_id FROM refs ORDER BY seq_id LIMIT 1)""",
    """wt_pos AS (SELECT wt_sequence, unnest(generate_series(1, length(wt_sequence))) AS pos FROM wt)""",
    """wt_res AS (SELECT CAST(pos AS INTEGER) AS pos, substr(wt_sequence, pos, 1) AS wt FROM wt_pos)""",
]


def profile(residues: str = "residues", name: str = "profile", pc: float = 1.0) -> list[str]:
    """A23 site profile over a residues CTE (pos, aa): residues are read once, into counts."""
    return [f"""{name}_all AS MATERIALIZED (SELECT pos, aa, count(*) AS n FROM {residues} GROUP BY pos, aa)"""] + profile_of_counts(f"{name}_all", name, pc)


def profile_of_counts(counts: str, name: str = "profile", pc: float = 1.0) -> list[str]:
    """A23 site profile over a CTE of counts (pos, aa, n)."""
    return [
        f"""{name}_counts AS (SELECT pos, aa, n FROM {counts} WHERE aa IN (SELECT aa FROM alpha))""",
        f"""{name}_grid AS (SELECT p.pos, a.aa FROM (SELECT DISTINCT pos FROM {counts}) p CROSS JOIN alpha a)""",
        f"""{name} AS MATERIALIZED (SELECT g.pos, g.aa,
  ln((coalesce(c.n, 0) + {pc}) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.pos) + {pc} * 20)) AS log_prob
  FROM {name}_grid g LEFT JOIN {name}_counts c ON g.pos = c.pos AND g.aa = c.aa)""",
    ]


SINGLE_MUTATIONS = [
    """muts AS (SELECT w.wt || CAST(w.pos AS VARCHAR) || a.aa AS mutant, w.wt, w.pos, a.aa AS mt
  FROM wt_res w CROSS JOIN alpha a)""",
]


H_SEQ = stable_hash_sql(42, "seq_id")

# W3 split of seqs (exact sizes, hash order)
TVT = [f"""tvt_r AS (SELECT seq_id, sequence,
   row_number() OVER (ORDER BY {H_SEQ}, seq_id) AS rn, count(*) OVER () AS n FROM seqs)""",
       """tvt AS (SELECT seq_id, sequence, CASE WHEN rn <= ceil(0.2 * n) THEN 'test'
   WHEN rn <= ceil(0.2 * n) + ceil(0.2 * (n - ceil(0.2 * n))) THEN 'valid' ELSE 'train' END AS split FROM tvt_r)"""]


def with_ctes(*parts: list[str], body: str) -> str:
    seen, out = set(), []
    for group in parts:
        for cte in group:
            name = cte.split(" AS ", 1)[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(cte)
    return "WITH " + ",\n".join(out) + "\n" + body
