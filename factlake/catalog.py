"""All registered queries of the fact engine and the SQL that checks them."""

from __future__ import annotations

from factlake.plans import facts, graphs, lifecycle, ranking, replication, stored, surface, text, writes
from factlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "facts", "graphs", "lifecycle", "ranking", "replication", "stored", "surface", "text", "writes"]
