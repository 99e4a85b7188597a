"""Registered queries (driver contract) and their SQL oracles.

Importing this package registers every query module.
"""

from seqframe.plans import mutation_queries  # noqa: F401
from seqframe.plans import sequence_queries  # noqa: F401
from seqframe.plans import split_metric_queries  # noqa: F401
from seqframe.plans import feature_queries  # noqa: F401
from seqframe.plans import ml_queries  # noqa: F401
from seqframe.plans import io_queries  # noqa: F401
