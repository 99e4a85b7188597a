"""seqframe: sequence analytics as Spark DataFrame operators.

Tables of sequences, aligned families and measured variants go in; ranked
variants, feature tables, metrics and model scores come out. Every operator
takes and returns DataFrames (or Columns) so Catalyst plans the whole job.
"""

from seqframe.session import (  # noqa: F401
    bounded_broadcast,
    checkpoint_dir,
    cut_lineage,
    get_session,
)

__version__ = "0.1.0"
