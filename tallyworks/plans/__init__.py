"""Registered queries: each names a job over the given tables and, where SQL can say it, its DuckDB text."""

from . import basics, comparisons, descriptive, files, modelling, resampling, surveys, timeseries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
