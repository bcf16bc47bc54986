"""SQL text per query name."""

from __future__ import annotations

from oracle import library, measures, pricing, stages, summary, texts, views
from oracle.ctes import with_blocks

MODULES = [stages, library, measures, views, summary, texts, pricing]


def all_sql() -> dict[str, str]:
    return {name: with_blocks(text) for m in MODULES for name, text in m.SQL.items()}
