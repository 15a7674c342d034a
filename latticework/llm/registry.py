"""Queries and SQL of the operators in this subpackage, as the entry point registers them."""

from __future__ import annotations

from importlib import import_module

#: Modules that define QUERIES and SQL.
MODULES = ("warc", "mixing", "bpe", "near_dedup", "nearest", "token_counts", "main_text", "fingerprints", "url_filter", "ordinal_quality")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"latticework.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"latticework.llm.{m}").SQL
    return out
