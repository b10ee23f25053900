"""All queries of the library but those of the training-data subpackage."""

from pyroclast.plans import assembled, documents, drawn, equipment, files, knowledge, plans_and_rules, relational, states  # noqa: F401
from pyroclast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
