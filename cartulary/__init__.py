"""Cartulary: a data catalog built from Spark DataFrames.

Profiles any set of tables, scores their quality, keeps the results in catalog
tables, builds prompts and fills descriptions with a generator of the caller's
choice, and keeps lineage as node and edge DataFrames that can be queried.
"""

from cartulary.session import build_session, materialize
from cartulary.sources.registry import Constraints, ForeignKey, Registry, TableSource

__all__ = [
    "build_session",
    "materialize",
    "Constraints",
    "ForeignKey",
    "Registry",
    "TableSource",
]
