"""All registered queries."""

from tickwarden.contract import data, decisions, detection, network  # noqa: F401
from tickwarden.contract.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
