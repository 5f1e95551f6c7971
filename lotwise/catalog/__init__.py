"""Every operator as a query over the given tables, with its SQL where it has one."""

from lotwise.catalog.registry import ORACLES, QUERIES
from lotwise.catalog import cleaning, columns, description, features, models, profiling, tables  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
