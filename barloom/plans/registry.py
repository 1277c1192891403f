"""All registered queries and their SQL."""

from . import histories, research, studies  # noqa: F401  they register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
