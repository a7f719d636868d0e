"""The registered queries and the SQL each is held against."""

from . import corpus_queries, retrieval_queries, source_queries

QUERIES = corpus_queries.QUERIES | retrieval_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = corpus_queries.ORACLE_SQL | retrieval_queries.ORACLE_SQL | source_queries.ORACLE_SQL
