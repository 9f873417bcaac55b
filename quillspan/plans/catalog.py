"""All queries of the library, by name."""

from quillspan.plans import cleaning, containers, counting, drawings, files, grouping, revisions  # noqa: F401
from quillspan.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
