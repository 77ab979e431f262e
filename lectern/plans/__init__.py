"""Named queries: importing this package registers all of them."""

from lectern.plans import (  # noqa: F401
    audio, audits, books, history, ingest, live, production, quality, serving,
)
from lectern.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
