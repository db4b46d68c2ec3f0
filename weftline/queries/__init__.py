"""Every operator as a query over the driver's tables, with SQL for comparison."""

from weftline.queries import extraction, graphs, refinement, responses, store, validation  # noqa: F401
from weftline.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
