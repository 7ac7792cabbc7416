"""Queries and SQL of the library."""

from . import corpus, documents, learning, questions, sampling

_PARTS = (sampling, documents, corpus, questions, learning)

QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: s for part in _PARTS for name, s in part.ORACLE_SQL.items()}
