"""All queries of the library by name, and the SQL that they equal."""

from __future__ import annotations

from weftgraph.plans import analysis, graph, ingest, learning, sampling  # noqa: F401
from weftgraph.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "link_prediction_report"
