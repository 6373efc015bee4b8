"""Queries over the driver's tables."""

from terraloc.plans import files, localization, queries, streams

__all__ = ["files", "localization", "queries", "streams"]
