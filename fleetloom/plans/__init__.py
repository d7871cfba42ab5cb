"""Registered queries: the operators run over the snapshot tables, each with a SQL twin."""

from fleetloom.plans import hierarchy, indexes, ingest, inventory, reports, series, streams, views, xmlevents  # noqa: F401
from fleetloom.plans.registry import ORACLES, QUERIES  # noqa: F401
