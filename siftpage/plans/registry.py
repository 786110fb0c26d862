"""All registered queries: importing a module of plans adds its own."""

from siftpage.plans import completing, contracting, decisions, discussions, evaluation, gatekeeping, linking, marking, publishing, reporting, responding, retrieval, scalar_rules, siting, structuring  # noqa: F401
from siftpage.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
