"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import q_cases, q_forms, q_pages, q_retrieval, q_review, q_text, q_whole

_MODULES = (q_cases, q_review, q_text, q_forms, q_pages, q_whole, q_retrieval)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.SQL.items()}
