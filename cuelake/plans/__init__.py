"""Registered queries."""

from . import catalog_more  # noqa: F401  (registers)
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
