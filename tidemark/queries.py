"""Query catalogue: one name -> (DataFrame function, DuckDB SQL)."""

from . import plans  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
