"""Registered queries over the driver's tables, each with SQL for its rows."""

from quern.queries import audit, catalog, columns, evaluation, guards, measures, readback, reports, reshaping, rows, sentences, systems, texts
from quern.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit", "catalog", "columns", "evaluation", "guards", "measures", "readback", "reports", "reshaping", "rows", "sentences", "systems", "texts"]
