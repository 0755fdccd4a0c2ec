"""All queries of the engine, by operator."""

from tessella.queries import grids, pools, search, tables  # noqa: F401
from tessella.queries.registry import ORACLE, QUERIES  # noqa: F401
