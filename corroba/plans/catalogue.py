"""The engine's named queries and their SQL counterparts."""

from __future__ import annotations

from corroba.plans import answers, atoms, claims, facts, inventory, pages, paths, prompts, reports, sources, texts  # noqa: F401
from corroba.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
