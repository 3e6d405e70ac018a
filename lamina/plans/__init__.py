"""Queries of the engine's own operators and the SQL that says the same; the training-data ones are elsewhere."""

from lamina.plans import accounts, archived, evaluation, indexed, ledger, listing, lookups, members, overview, publishing, reports, retrieval, scalars, scoped, scores, state, vocabulary, writes

_PARTS = (listing, vocabulary, retrieval, scalars, ledger, accounts, state, reports, writes, evaluation, lookups, publishing, indexed, archived, scoped, scores, overview, members)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
