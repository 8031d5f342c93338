"""All queries of the library on the driver's tables, and the SQL for the same rows."""

from __future__ import annotations

from tremolo.plans import detectors, evaluation, intervals, joins, live, location, packets, records, review, signals, stats  # noqa: F401
from tremolo.plans.joins import association_scorecard as flagship  # noqa: F401
from tremolo.plans.registry import ORACLES, QUERIES  # noqa: F401
