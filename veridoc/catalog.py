"""Every query of the package outside `llm`, with its SQL."""

from __future__ import annotations

from .plans import acronyms, answers, assess, editions, evaluation, families, figures, gate, gates, ledgers, passages, queue, registers, relational, retrieval, review, sections, stored, structure, text, transmittal

MODULES = (acronyms, answers, assess, editions, evaluation, families, figures, gate, gates, ledgers, passages, queue, registers, relational, retrieval, review, sections, stored, structure, text, transmittal)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
