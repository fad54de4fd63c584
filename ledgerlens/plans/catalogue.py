"""All registered queries of the engine and their SQL twins."""

from . import indexed, ledger, lifecycle, retrieval, rules, selection, statistics  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "r20_context"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
