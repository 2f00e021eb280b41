"""The registered queries and their SQL oracles."""

from __future__ import annotations

from quern.plans import queries_engine, queries_misc, queries_pages, queries_search  # noqa: F401  they register themselves
from quern.plans.registry import ORACLES, QUERIES  # noqa: F401
