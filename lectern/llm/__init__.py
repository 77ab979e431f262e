"""Operators for training corpora, each with a query ``opN_<name>``."""

from lectern.llm import queries  # noqa: F401
from lectern.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
