"""Example queries: one per operator, each with its SQL twin where SQL can say it."""

from plumbline.plans.catalogue.registry import ORACLE, QUERIES
from plumbline.plans.catalogue import (  # noqa: F401  (importing registers the queries)
    aggregates,
    composites,
    distances,
    masterdata,
    predicates,
    scalars,
    tables,
)

__all__ = ["ORACLE", "QUERIES"]
