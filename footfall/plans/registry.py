"""Queries by name, and the SQL that must give the same rows."""

from footfall.plans import kernels, relational

QUERIES: dict = relational.QUERIES | kernels.QUERIES
ORACLES: dict = relational.ORACLES | kernels.ORACLES
