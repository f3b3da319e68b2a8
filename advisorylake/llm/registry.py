"""Queries of this subpackage and their SQL twins, in the form the entry file collects."""

from __future__ import annotations

from types import SimpleNamespace

from advisorylake.llm import queries

reg = SimpleNamespace(queries=queries.QUERIES, oracles=queries.ORACLES)
