"""Queries over the provided tables, each with the SQL that it equals."""

from __future__ import annotations

from . import intervals, packs, retrieval, sequences, serving, statistics, studies

MODULES = (retrieval, intervals, sequences, statistics, serving, packs, studies)

QUERIES = {name: query for m in MODULES for name, (query, _) in m.PLANS.items()}
SQL = {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
