"""All queries of the core; importing the modules registers them."""

from siltmark.plans import audits, curation, evaluation, process, similarity  # noqa: F401
from siltmark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
