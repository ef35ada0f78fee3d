"""All queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from mnemospark.plans import core, lineage, moments, oracles

QUERIES = core.QUERIES | moments.QUERIES | lineage.QUERIES
ORACLES = oracles.ORACLES | lineage.ORACLES
