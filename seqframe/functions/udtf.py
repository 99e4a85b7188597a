"""One-to-many generator for SQL users.

``single_mutants(sequence, offset)`` emits every single-residue code of a
sequence (20 per position, wt->wt included) as a Python UDTF, so SQL can
write ``SELECT * FROM single_mutants('MKT', 1)`` or use it in a lateral
join. The DataFrame operator ``mutants.single_mutations`` is the JVM-side
equivalent for tables and is what the library uses internally.
"""

from __future__ import annotations

from pyspark.sql.functions import udtf

from seqframe.functions.sequences import ALPHABET


@udtf(returnType="mutant string, wt string, pos int, mt string")
class SingleMutants:
    def eval(self, sequence: str, offset: int = 1):
        if sequence is None:
            return
        for i, wt in enumerate(sequence):
            number = i + offset
            for mt in ALPHABET:
                yield f"{wt}{number}{mt}", wt, i + 1, mt


def register(spark) -> None:
    spark.udtf.register("single_mutants", SingleMutants)
