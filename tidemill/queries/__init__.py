"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from tidemill.queries import charts, cleaning, features, logs, models, profiles, streams  # noqa: F401
from tidemill.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
