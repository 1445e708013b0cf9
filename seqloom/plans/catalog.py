"""All registered queries and their DuckDB equivalents."""

from seqloom.plans.queries import damage, em, matrix, pairs, report, sequence  # noqa: F401  (they register)
from seqloom.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "flagship"
