"""Named queries over a folder of tables."""

from . import audit, detection, monitoring, preparation, references, scores  # noqa: F401
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
