"""Registered queries over the shared test tables, each with an SQL counterpart where one exists."""

from fieldpulse.catalog.registry import REGISTRY
from fieldpulse.catalog import ingest, retrieval, streams, text, triage, updates  # noqa: F401

__all__ = ["REGISTRY"]
