"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import more_queries, scalar_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
