"""The registered queries on the driver tables, each with its SQL where there is one."""

from martloom.catalog import columns, combine, evaluate, learn, rows, runs, split, typing  # noqa: F401
from martloom.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
