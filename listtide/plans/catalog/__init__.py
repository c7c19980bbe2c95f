"""All registered queries and their SQL equivalents."""

from . import changes, feeds, jobs, joins, predicates, rules, scalars  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
