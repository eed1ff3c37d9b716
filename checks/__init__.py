"""Registered queries with their DuckDB twins."""

from . import decisions, extract, models, sold, weighting

MODULES = [extract, sold, weighting, decisions, models]
