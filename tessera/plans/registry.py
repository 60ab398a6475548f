"""All queries of the library itself, and their SQL."""

from . import code_queries, index_queries, text_queries, vector_queries

_MODULES = (vector_queries, text_queries, code_queries, index_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
