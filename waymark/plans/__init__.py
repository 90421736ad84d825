"""All queries by name, and their SQL."""

from waymark.plans import bounded, eventlog, graphs, live, paths, reports, states, streams, tables, topology  # noqa: F401
from waymark.plans.registry import ORACLE, QUERIES  # noqa: F401
