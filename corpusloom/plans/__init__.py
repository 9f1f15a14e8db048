"""Queries and the report."""

from . import queries as queries
