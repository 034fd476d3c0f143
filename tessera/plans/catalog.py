"""All queries of the library, and their SQL."""

from __future__ import annotations

from tessera.plans import answer_queries, diagnosis_queries, evidence_queries, finance_queries, retrieval_queries

MODULES = (retrieval_queries, evidence_queries, answer_queries, finance_queries, diagnosis_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
