"""The queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_secrets", "q_quality", "q_jaccard", "q_language", "q_mixing", "q_chat", "q_lattice", "q_html", "q_urls", "q_contamination", "q_importance", "q_divergence", "q_warc")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"serieslab.llm.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
