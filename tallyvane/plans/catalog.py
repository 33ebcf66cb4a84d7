"""All queries of the core library."""

from __future__ import annotations

from tallyvane.plans import aggregates, answers, decisions, diagnostics, episodes, outputs, relations, sampling, texts  # noqa: F401  (they register themselves)
from tallyvane.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "a4_a5_hallucination_chm"
