"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import bookings, clusters, delivery, features, files, reports, texts

MODULES = (delivery, bookings, features, reports, texts, clusters, files)
ENTRIES = {name: entry for module in MODULES for name, entry in module.QUERIES.items()}
QUERIES = {name: query for name, (query, _) in ENTRIES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
