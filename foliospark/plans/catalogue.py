"""The query catalogue: every registered query and its SQL."""

from __future__ import annotations

from foliospark.plans import contracts, documents, evidence, gate, hygiene, notes, notes_audit, package, provenance, quality, relational, streams, structure, terms, text  # noqa: F401
from foliospark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
