"""Named queries over the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from martline.plans import analytics, basics, contract, mart, ops, questions, star, warehouse
from martline.plans.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "basics", "contract", "mart", "ops", "questions", "star", "warehouse"]
