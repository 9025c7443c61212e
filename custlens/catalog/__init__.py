"""Named queries over the star-schema tables, and plain SQL that says what each must return."""

from custlens.catalog import modelling, preparation, relational  # noqa: F401  (they register their queries)
from custlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
