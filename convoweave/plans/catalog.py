"""All named queries of the engine and their SQL."""

from convoweave.plans import finding, ingest, listing

MODULES = (listing, finding, ingest)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
