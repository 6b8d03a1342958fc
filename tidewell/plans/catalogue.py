"""All registered queries and SQL twins."""

from __future__ import annotations

from tidewell.plans import devices, experiments, files, registries, requests, streams, telemetry

_MODULES = (devices, requests, files, registries, experiments, telemetry, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
