"""The registered queries of the library over the driver tables, and their SQL equivalents."""

from . import claims, details, documents, enrichment, facets, lists, loads, maintenance, matching, payloads, places, plans, quality, serving, terms, texts  # noqa: F401  (they register themselves)
from ._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
