"""Queries over the driver's tables and the SQL that gives the same rows."""

from lectern.queries import clusters, documents, files, live, readers, stores, talks, transcripts, voices

MODULES = (transcripts, voices, documents, files, clusters, readers, live, talks, stores)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
