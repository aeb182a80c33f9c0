"""The subpackage's queries and their SQL, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this subpackage that has it
WHERE = {
    "op1_quality_rules": "quality_rules",
    "op2_weak_labels": "weak_labels",
    "op3_packing": "packing",
    "op4_toxicity": "toxicity",
    "op8_mixing": "mixing",
    "op5_html_text": "html_text",
    "op6_pii": "pii",
    "op7_near_dedup": "near_dedup",
    "op9_topk": "topk",
    "op10_chat": "chat",
}


def queries(*names: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The named queries, all if none is named."""
    return {name: getattr(import_module(f".{WHERE[name]}", __package__), name) for name in names or WHERE}


def oracle_sql(*names: str) -> dict[str, str]:
    found = {name: getattr(import_module(f".{WHERE[name]}", __package__), "ORACLE", None) for name in names or WHERE}
    return {name: sql for name, sql in found.items() if sql}
