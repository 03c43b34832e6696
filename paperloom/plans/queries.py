"""All queries of the core, with their SQL where SQL can express them."""

from __future__ import annotations

from paperloom.plans.core_problems import ORACLES as _PROBLEM_SQL
from paperloom.plans.core_problems import QUERIES as _PROBLEMS
from paperloom.plans.reference_queries import ORACLES as _SQL
from paperloom.plans.reference_queries import QUERIES as _DOCUMENTS
from paperloom.plans.reference_queries import invoice_roundtrip_kv as flagship

QUERIES = {**_DOCUMENTS, **_PROBLEMS}
ORACLES: dict[str, str] = {**_SQL, **_PROBLEM_SQL}

__all__ = ["ORACLES", "QUERIES", "flagship"]
