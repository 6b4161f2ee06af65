"""All registered queries: importing a module of queries adds them to one table."""

from __future__ import annotations

from tidemark.plans import code, flows, nested, records, structure, tables
from tidemark.plans.queries import QUERIES, SQL

MODULES = (structure, records, tables, code, nested, flows)

__all__ = ["MODULES", "QUERIES", "SQL"]
