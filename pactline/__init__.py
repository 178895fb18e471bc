"""Data contracts and run observability as Spark DataFrame jobs."""

from pactline.sources.contracts import ColumnRule, Contract
from pactline.sources.resolve import Resolved, parse_uri, resolve

__all__ = ["ColumnRule", "Contract", "Resolved", "parse_uri", "resolve"]
