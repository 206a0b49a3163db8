"""Registered queries of the evaluation library, with their SQL twins."""

from __future__ import annotations

from evalspark.plans import datasets, lifecycle, more, reporting, running

QUERIES: dict = reporting.QUERIES | datasets.QUERIES | lifecycle.QUERIES | more.QUERIES | running.QUERIES
ORACLES: dict[str, str] = reporting.ORACLES | datasets.ORACLES | lifecycle.ORACLES | more.ORACLES | running.ORACLES
