"""Queries of the training-data operators, one opN_<name> each."""

from __future__ import annotations

import importlib

MODULES = (
    "decontaminate",
    "pii",
    "suffix_dedup",
    "quality",
    "audio",
    "langid",
    "mixing",
    "toxicity",
    "lm",
    "jaccard",
)


def _modules():
    return [importlib.import_module(f"tessera.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
